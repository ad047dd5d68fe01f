"""Per-person style metrics and set overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.functions import text as tx
from talkweave.plans.ordered import top_rows


def style_profile(messages: DataFrame) -> DataFrame:
    """Mean length, emoji rate and code-mix ratio per person."""
    body = F.col("text")
    return messages.groupBy("workspace_id", "sender").agg(
        F.avg(F.length(body)).alias("avg_message_length"),
        F.avg(tx.emoji_rate(body)).alias("emoji_rate"),
        F.avg(tx.codemix_ratio(body)).alias("codemix_ratio"),
    )


def style_labels(profile: DataFrame) -> DataFrame:
    return profile.withColumn("emoji_label", tx.emoji_label(F.col("emoji_rate"))).withColumn(
        "codemix_label", tx.codemix_label(F.col("codemix_ratio"))
    )


def solo_examples(samples: DataFrame, part: Sequence[str], order: str, limit: int = 8) -> DataFrame:
    """First ``limit`` distinct non-blank texts of each part."""
    body = tx.strip(F.col("text"))
    distinct = (
        samples.select(*part, order, body.alias("text"))
        .filter("text <> ''")
        .groupBy(*part, "text")
        .agg(F.min(order).alias(order))
    )
    return top_rows(distinct, part, [F.col(order)], limit)


def set_overlap(elements: DataFrame, part: str, side: str, a: str, b: str, element: str) -> DataFrame:
    """Jaccard overlap of the element sets of two sides, without building either set.

    Elements are reduced to one row each before they meet, so repeats cost nothing.  A part
    whose rows are all of other sides has two empty sets, which are equal (1).
    """
    parts = elements.select(part).distinct()
    seen = elements.filter(F.col(side).isin(a, b)).groupBy(part, element).agg(
        F.max((F.col(side) == a).cast("int")).alias("in_a"), F.max((F.col(side) == b).cast("int")).alias("in_b")
    )
    met = seen.groupBy(part).agg(
        F.sum(F.col("in_a") * F.col("in_b")).alias("shared"),
        F.count(F.lit(1)).alias("all_elements"),
        (F.sum(F.col("in_a") * F.col("in_b")) / F.count(F.lit(1))).alias("jaccard"),
    )
    return parts.join(met, part, "left").fillna({"shared": 0, "all_elements": 0, "jaccard": 1.0})
