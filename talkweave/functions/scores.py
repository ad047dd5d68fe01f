"""Score adjustment, gates and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_or_zero(score: Column) -> Column:
    return F.coalesce(score.cast("double"), F.lit(0.0))


def passes_gate(score: Column, minimum: Column | float) -> Column:
    """Score reaches the minimum; a minimum of 0 or less lets everything pass."""
    floor = minimum if isinstance(minimum, Column) else F.lit(float(minimum))
    return (floor <= 0) | (score_or_zero(score) >= floor)


def clamp01(score: Column) -> Column:
    """Into [0, 1]; null stays null, which ``least`` and ``greatest`` alone would not keep."""
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def adjusted(score: Column, delta: Column) -> Column:
    """Add a delta and clamp to [0, 1]; a zero delta leaves the score alone."""
    return F.when(delta == 0, score_or_zero(score)).otherwise(clamp01(score_or_zero(score) + delta))


def recency_delta(ts: Column, as_of: Column, intent: Column) -> Column:
    """Boost by age: 'current' favours fresh rows, 'historical' old ones, else half boost."""
    fresh = ts >= as_of - F.expr("INTERVAL 30 DAYS")
    recent = ts >= as_of - F.expr("INTERVAL 90 DAYS")
    old = ts < as_of - F.expr("INTERVAL 180 DAYS")
    delta = (
        F.when(intent == "current", F.when(fresh, 0.10).when(recent, 0.05).otherwise(0.0))
        .when(intent == "historical", F.when(fresh, -0.03).when(old, 0.05).otherwise(0.0))
        .otherwise(F.when(fresh, 0.05).when(recent, 0.02).otherwise(0.0))
    )
    return F.when(ts.isNull(), 0.0).otherwise(delta)


def dual_gate(
    queries: Column, seen: Column, single: float = 0.35, multi: float = 0.22
) -> Column:
    """Minimum score of a hit: one query, several queries, or several and seen twice."""
    return (
        F.when(queries <= 1, F.lit(single))
        .when(seen >= 2, F.lit(max(multi * 0.65, 0.10)))
        .otherwise(F.lit(multi))
    )


def hour_label(hour: Column) -> Column:
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    return F.concat(twelve, F.when(hour < 12, " AM").otherwise(" PM"))


def duration_label(seconds: Column) -> Column:
    """``45s``, ``3m 20s``, ``2h 5m``; a zero second part is left out."""
    s = F.floor(seconds).cast("bigint")
    minutes, rest = F.floor(s / 60).cast("bigint"), s % 60
    hours, mins = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint")

    def two(a: Column, a_unit: str, b: Column, b_unit: str) -> Column:
        head = F.concat(a.cast("string"), F.lit(a_unit))
        return F.when(b == 0, head).otherwise(F.concat(head, F.lit(" "), b.cast("string"), F.lit(b_unit)))

    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, two(minutes, "m", rest, "s"))
        .otherwise(two(hours, "h", mins, "m"))
    )


def person_status(count: Column, thin: int = 50, ready: int = 200) -> Column:
    return F.when(count < thin, "not_enough").when(count < ready, "thin").otherwise("ready")


def heat_level(count: Column, peak: Column) -> Column:
    """Heat step 0-5 of a cell by its share of the busiest cell."""
    ratio = count / F.greatest(peak, F.lit(1)).cast("double")
    return (
        F.when(ratio <= 0, 0)
        .when(ratio < 0.2, 1)
        .when(ratio < 0.4, 2)
        .when(ratio < 0.65, 3)
        .when(ratio < 0.85, 4)
        .otherwise(5)
        .cast("bigint")
    )
