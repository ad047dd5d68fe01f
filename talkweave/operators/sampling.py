"""Samples of a person's messages: even stride, recency weighted, one per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.plans.ordered import dense_position, keep_evenly, time_levels, top_rows
from talkweave.schema import BLOCK_ROWS

PERSON = ["workspace_id", "sender"]


def person_positions(messages: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Messages with ``pos`` and ``n`` per person in time order."""
    return dense_position(
        messages, PERSON, [F.col("ts"), F.col("seq")], time_levels("ts", "seq", block), "pos", "n"
    )


def spread_evenly(positioned: DataFrame, picks: int) -> DataFrame:
    return positioned.filter(keep_evenly(F.col("pos"), F.col("n"), F.lit(picks)))


def recency_sample(positioned: DataFrame, limit: int = 60, recent_share: float = 0.6) -> DataFrame:
    """60 % of the picks from the newest third, the rest from the older two thirds."""
    split = F.greatest(F.lit(1), F.floor(F.col("n") * 2 / 3).cast("bigint"))
    newer = F.col("n") - split
    from_newer = F.least(F.lit(round(limit * recent_share)), newer)
    from_older = F.least(limit - from_newer, split)
    chosen = F.when(
        F.col("pos") < split, keep_evenly(F.col("pos"), split, from_older)
    ).otherwise(keep_evenly(F.col("pos") - split, newer, from_newer))
    return positioned.filter((F.col("n") <= limit) | chosen)


def monthly_samples(messages: DataFrame, limit: int = 20, block: int = BLOCK_ROWS) -> DataFrame:
    """Newest message of each month, filled up by an even stride over the others.

    The monthly picks are an aggregation with map-side partial results; the others are
    ranked without them.
    """
    month = F.date_trunc("month", "ts")
    newest = messages.groupBy(*PERSON, month.alias("_month")).agg(
        F.max_by("message_id", F.struct(F.col("ts"), -F.col("seq"))).alias("message_id")
    )
    monthly = top_rows(newest, PERSON, [F.col("_month").desc()], limit).select(*PERSON, "message_id")
    picked = monthly.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("_taken"))
    others = messages.join(monthly.select("workspace_id", "message_id"), ["workspace_id", "message_id"], "left_anti")
    ranked = person_positions(others, block).withColumnRenamed("n", "_others")
    extras = (
        ranked.join(picked, PERSON)
        .filter(keep_evenly(F.col("pos"), F.col("_others"), limit - F.col("_taken")))
        .select(*PERSON, "message_id")
    )
    return messages.join(
        monthly.unionByName(extras).select("workspace_id", "message_id"),
        ["workspace_id", "message_id"],
    )
