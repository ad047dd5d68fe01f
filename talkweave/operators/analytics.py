"""Conversation analytics over many workspaces at once.

Counts go through map-side partial aggregation, so a workspace holding a third of all rows
costs one partial row per task.  Exact medians keep one counter per distinct value, and
the values (seconds up to four hours, text lengths) are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions.scores import person_status
from talkweave.plans.ordered import top_rows

WS = "workspace_id"
MIN_MEDIAN_SAMPLES = 3


def guarded_median(value: Column) -> Column:
    """Exact median, null with fewer than three samples."""
    return F.when(F.count(value) >= MIN_MEDIAN_SAMPLES, F.median(value))


def sender_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(WS, "sender").agg(F.count(F.lit(1)).alias("message_count"))


def sender_share(counts: DataFrame) -> DataFrame:
    total = F.sum("message_count").over(Window.partitionBy(WS))
    return counts.withColumn("share_percent", F.col("message_count") * 100.0 / total)


def median_length(messages: DataFrame) -> DataFrame:
    """Median text length of messages with at least two characters; 0 without any."""
    size = F.length("text")
    return messages.groupBy(WS, "sender").agg(
        F.coalesce(F.median(F.when(size >= 2, size)), F.lit(0.0)).alias("median_length")
    )


def activity_counts(messages: DataFrame, *keys: str) -> DataFrame:
    """Counts by hour (0-23) and weekday (Monday 0) of each key: the cube the rest rolls up."""
    return messages.groupBy(
        *keys, F.hour("ts").cast("bigint").alias("hour"), F.weekday("ts").cast("bigint").alias("weekday")
    ).agg(F.count(F.lit(1)).alias("message_count"))


def roll_up(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(F.sum("message_count").alias("message_count"))


def dense_heatmap(cube: DataFrame) -> DataFrame:
    """All 168 cells of every workspace, zeros included."""
    full = (
        cube.select(WS)
        .distinct()
        .withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6)).cast("array<bigint>")))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>")))
    )
    return full.join(cube, [WS, "weekday", "hour"], "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0))
    )


def week_key(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def weekly_series(messages: DataFrame) -> DataFrame:
    monday = F.date_trunc("week", F.col("ts"))
    return (
        messages.groupBy(WS, monday.alias("monday"))
        .agg(F.count(F.lit(1)).alias("message_count"))
        .withColumn("week", week_key(F.col("monday")))
        .withColumn("label", F.date_format("monday", "MMM dd"))
    )


def monthly_series(weeks: DataFrame) -> DataFrame:
    """Weeks rolled up to the month that holds their Monday."""
    return weeks.groupBy(WS, F.date_format("monday", "yyyy-MM").alias("month")).agg(
        F.sum("message_count").alias("message_count")
    )


def trailing_weeks(weeks: DataFrame, as_of: Column, n: int = 52) -> DataFrame:
    """The last ``n`` active weeks that have begun at ``as_of``."""
    return top_rows(weeks.filter(F.col("monday") <= as_of), [WS], [F.col("monday").desc()], n, "recency")


def top_weeks(weeks: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(weeks, [WS], [F.col("message_count").desc(), F.col("monday")], n)


def top_buckets(counts: DataFrame, part: list[str], bucket: str, n: int) -> DataFrame:
    """Busiest ``n`` hours or weekdays; ties go to the smaller bucket."""
    return top_rows(counts, part, [F.col("message_count").desc(), F.col(bucket)], n)


def busiest(counts: DataFrame, part: list[str], bucket: str, out: str) -> DataFrame:
    return counts.groupBy(*part).agg(
        F.max_by(bucket, F.struct(F.col("message_count"), -F.col(bucket))).alias(out)
    )


def messages_per_day(messages: DataFrame) -> DataFrame:
    """Messages over days from the first to the last line of the file, at least one day."""
    days = F.greatest(
        F.lit(1), F.datediff(F.max_by("ts", "seq").cast("date"), F.min_by("ts", "seq").cast("date")) + 1
    )
    return messages.groupBy(WS).agg(
        F.count(F.lit(1)).alias("message_count"),
        days.cast("bigint").alias("span_days"),
        (F.count(F.lit(1)) / days).alias("messages_per_day"),
    )


def initiations(events: DataFrame) -> DataFrame:
    """Session starts per sender: the first turn and every turn after a long gap."""
    opened = F.col("kind").isin("first", "initiation", "pickup")
    return events.groupBy(WS, "sender").agg(F.sum(opened.cast("bigint")).alias("initiations"))


def replies_given_received(events: DataFrame) -> DataFrame:
    replies = events.filter(F.col("kind").isin("pickup", "burst"))
    sides = replies.select(
        WS,
        F.explode(
            F.array(
                F.struct(F.col("sender").alias("who"), F.lit(1).alias("given"), F.lit(0).alias("received")),
                F.struct(F.col("previous_sender").alias("who"), F.lit(0).alias("given"), F.lit(1).alias("received")),
            )
        ).alias("side"),
    )
    return sides.groupBy(WS, F.col("side.who").alias("sender")).agg(
        F.sum("side.given").alias("replies_given"), F.sum("side.received").alias("replies_received")
    )


def pickup_gap() -> Column:
    return F.when(F.col("kind") == "pickup", F.col("gap_seconds"))


def burst_gap() -> Column:
    return F.when((F.col("kind") == "burst") & (F.col("gap_seconds") > 0), F.col("gap_seconds"))


def reply_medians(events: DataFrame) -> DataFrame:
    return events.groupBy(WS, "sender").agg(
        guarded_median(pickup_gap()).alias("pickup_median"),
        guarded_median(burst_gap()).alias("burst_median"),
    )


def group_pickup_median(events: DataFrame) -> DataFrame:
    return events.groupBy(WS).agg(guarded_median(pickup_gap()).alias("pickup_median"))


# Reply-time bins, lower bound included, in seconds.
RESPONSE_BINS = ((0, 60, "<1m"), (60, 300, "1-5m"), (300, 1800, "5-30m"), (1800, None, "30m+"))


def in_bin(low: int, high: int | None) -> Column:
    """An in-session reply whose time lies in a bin."""
    gap = burst_gap()
    hit = gap >= low
    return F.coalesce(hit & (gap < high) if high is not None else hit, F.lit(False))


def response_histogram(events: DataFrame) -> DataFrame:
    """In-session reply times in four bins per sender, empty bins included."""
    cells = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("bin"), F.lit(label).alias("label"), F.col(f"_b{i}").alias("replies"))
            for i, (_, _, label) in enumerate(RESPONSE_BINS)
        ]
    )
    return (
        events.groupBy(WS, "sender")
        .agg(
            *[
                F.sum(in_bin(lo, hi).cast("bigint")).alias(f"_b{i}")
                for i, (lo, hi, _) in enumerate(RESPONSE_BINS)
            ]
        )
        .select(WS, "sender", F.inline(cells))
    )


def reply_edges(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy(WS, "target", F.col("sender").alias("replier")).agg(
        F.count(F.lit(1)).alias("replies")
    )


def pair_stats(attributed: DataFrame) -> DataFrame:
    """Undirected pairs, names in alphabetical order, both directions counted."""
    first = F.least("target", "sender")
    return attributed.groupBy(
        WS, first.alias("person_a"), F.greatest("target", "sender").alias("person_b")
    ).agg(
        F.sum((F.col("target") == first).cast("bigint")).alias("a_to_b"),
        F.sum((F.col("target") != first).cast("bigint")).alias("b_to_a"),
        F.count(F.lit(1)).alias("exchanges"),
        guarded_median(pickup_gap()).alias("pickup_median"),
        guarded_median(burst_gap()).alias("burst_median"),
    )


def connection_scores(pairs: DataFrame, turn_table: DataFrame) -> DataFrame:
    """Exchanges over the mean number of turns of both people, in percent, at most 100."""
    spoken = turn_table.groupBy(WS, "sender").agg(F.count(F.lit(1)).alias("turns"))
    a = spoken.select(WS, F.col("sender").alias("person_a"), F.col("turns").alias("turns_a"))
    b = spoken.select(WS, F.col("sender").alias("person_b"), F.col("turns").alias("turns_b"))
    base = F.greatest(F.lit(1.0), (F.coalesce("turns_a", F.lit(0)) + F.coalesce("turns_b", F.lit(0))) / 2.0)
    return (
        pairs.join(a, [WS, "person_a"], "left")
        .join(b, [WS, "person_b"], "left")
        .withColumn("connection_score", F.least(F.lit(100.0), F.bround(F.col("exchanges") * 100.0 / base, 1)))
    )


def strongest_pair(scored: DataFrame) -> DataFrame:
    ranked = top_rows(
        scored, [WS], [F.col("connection_score").desc(), F.col("person_a"), F.col("person_b")], 1
    )
    return ranked.drop("rank")


def people_roster(messages: DataFrame) -> DataFrame:
    """One row per person: deterministic id, counts, first and last seen, status."""
    return (
        messages.groupBy(WS, "sender")
        .agg(
            F.count(F.lit(1)).alias("message_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .withColumn("status", person_status(F.col("message_count")))
        .withColumn("person_id", person_id())
    )


def person_id(sender: str = "sender") -> Column:
    return F.sha2(F.concat_ws("␟", F.col(WS), F.col(sender)), 256)


def top_speakers(counts: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(counts, [WS], [F.col("message_count").desc(), F.col("sender")], n)


def workspace_summary(messages: DataFrame) -> DataFrame:
    people = messages.groupBy(WS, "sender").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    return people.groupBy(WS).agg(
        F.sum("n").alias("message_count"),
        F.count(F.lit(1)).alias("speaker_count"),
        F.min("lo").alias("date_from"),
        F.max("hi").alias("date_to"),
        (F.count(F.lit(1)) > 2).alias("is_group"),
    )


HOURS, DAYS = range(24), range(7)


def counted_in(value: Column, buckets: range) -> Column:
    """Aggregate: how many rows lie in each bucket, as an array."""
    return F.array(*[F.count_if(value == b) for b in buckets])


def ranked_buckets(counts: Column, n: int) -> Column:
    """``[{bucket, message_count}]`` of the ``n`` busiest buckets with any; ties go to the smaller one."""
    cells = F.transform(counts, lambda c, i: F.struct((-c).alias("down"), i.cast("bigint").alias("bucket")))
    best = F.slice(F.array_sort(F.filter(cells, lambda c: c["down"] < 0)), 1, n)
    return F.transform(best, lambda c: F.struct(c["bucket"].alias("bucket"), (-c["down"]).alias("message_count")))


def person_scorecard(messages: DataFrame, events: DataFrame) -> DataFrame:
    """One wide row per person.

    All message metrics come from one aggregation and all reply metrics from another, so
    the two big inputs are each aggregated once.  ``response_bins`` holds the counts of
    ``RESPONSE_BINS``, zeros for people without replies.
    """
    size = F.length("text")
    base = messages.groupBy(WS, "sender").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.coalesce(F.median(F.when(size >= 2, size)), F.lit(0.0)).alias("median_length"),
        counted_in(F.hour("ts"), HOURS).alias("_hours"),
        counted_in(F.weekday("ts"), DAYS).alias("_days"),
    )
    base = sender_share(base).withColumns(
        {"active_hours": ranked_buckets(F.col("_hours"), 3), "active_days": ranked_buckets(F.col("_days"), 3)}
    )
    base = base.withColumn("peak_hour", F.col("active_hours")[0]["bucket"])
    opened = F.col("kind").isin("first", "initiation", "pickup")
    replied = F.col("kind").isin("pickup", "burst")
    replies = events.groupBy(WS, "sender").agg(
        F.count_if(replied).alias("replies_given"),
        F.count_if(opened).alias("initiations"),
        guarded_median(pickup_gap()).alias("pickup_median"),
        guarded_median(burst_gap()).alias("burst_median"),
        F.array(*[F.count_if(in_bin(lo, hi)) for lo, hi, _ in RESPONSE_BINS]).alias("response_bins"),
    )
    received = (
        events.filter(replied)
        .groupBy(WS, F.col("previous_sender").alias("sender"))
        .agg(F.count(F.lit(1)).alias("replies_received"))
    )
    zero = ("replies_given", "replies_received", "initiations")
    none = F.array(*[F.lit(0).cast("bigint")] * len(RESPONSE_BINS))
    return (
        base.drop("_hours", "_days")
        .join(replies, [WS, "sender"], "left")
        .join(received, [WS, "sender"], "left")
        .fillna(0, list(zero))
        .withColumn("response_bins", F.coalesce("response_bins", none))
    )


def group_scorecard(messages: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per workspace: pace, active hours, days and weeks, pickup median, strongest pair.

    Everything about messages but the weeks is one aggregation.
    """
    weeks = top_weeks(weekly_series(messages)).groupBy(WS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "week", "message_count"))), lambda w: F.struct(w["week"].alias("week"), w["message_count"].alias("message_count"))
        ).alias("top_weeks")
    )
    days = F.greatest(F.lit(1), F.datediff(F.max_by("ts", "seq").cast("date"), F.min_by("ts", "seq").cast("date")) + 1)
    base = messages.groupBy(WS).agg(
        F.count(F.lit(1)).alias("message_count"), days.cast("bigint").alias("span_days"), (F.count(F.lit(1)) / days).alias("messages_per_day"),
        ranked_buckets(counted_in(F.hour("ts"), HOURS), 5).alias("active_hours"), ranked_buckets(counted_in(F.weekday("ts"), DAYS), 7).alias("active_days"),
    )
    return (
        base.withColumns({"busiest_hour": F.col("active_hours")[0]["bucket"], "busiest_weekday": F.col("active_days")[0]["bucket"]})
        .join(weeks, WS)
        .join(group_pickup_median(events), WS, "left")
        .join(
            strongest_pair(pairs).select(WS, "person_a", "person_b", "connection_score"), WS, "left"
        )
    )
