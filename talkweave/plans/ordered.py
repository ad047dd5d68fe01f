"""Ordered scans cut into bounded blocks.

A window over ``partitionBy(workspace).orderBy(seq)`` sorts a whole workspace in one
task.  When one workspace holds a third of all rows that task never ends.  The functions
here give the same answers from windows over ``(workspace, block)``: each block is
bounded, and what crosses a block edge travels through a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.schema import BLOCK_ROWS


def block_of(col: str | Column, block: int = BLOCK_ROWS) -> Column:
    """Number of the block of ``block`` consecutive integers that holds ``col``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(block)).cast("bigint")


def time_levels(ts: str = "ts", seq: str = "seq", block: int = BLOCK_ROWS) -> list[Column]:
    """Levels for the order ``(ts, seq)``: day, exact time, block of ``seq``.

    Days per part, distinct times per day and blocks per time are all bounded or thin,
    even when one instant holds most rows.
    """
    return [F.date_trunc("day", F.col(ts)), F.col(ts), block_of(seq, block)]


def seq_levels(seq: str = "seq", block: int = BLOCK_ROWS) -> list[Column]:
    """Levels for the order ``seq``: one level of fixed-width blocks."""
    return [block_of(seq, block)]


def dense_position(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Column],
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based rank of each row in its ``part``; ``total`` names a column for the part size.

    ``levels`` run from coarse to fine and must follow ``order``.  The rows are shuffled
    once, by part and levels; everything else works on counts.
    """
    part = list(part)
    names = [f"_lv{i}" for i in range(len(levels))]
    marked = df
    for name, level in zip(names, levels):
        marked = marked.withColumn(name, level)

    counts = marked.groupBy(*part, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts
    for depth in range(len(names)):
        keys = part + names[: depth + 1]
        level = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")) if depth + 1 < len(names) else counts
        w = (
            Window.partitionBy(*part, *names[:depth])
            .orderBy(names[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        level = level.select(
            *keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_off{depth}")
        )
        offsets = offsets.join(level, keys)
    offsets = offsets.withColumn(
        "_offset", sum((F.col(f"_off{d}") for d in range(1, len(names))), F.col("_off0"))
    )
    keep = [*part, *names, "_offset"]
    if total:
        totals = counts.groupBy(*part).agg(F.sum("_n").alias(total))
        offsets = offsets.join(totals, part)
        keep.append(total)

    inner = Window.partitionBy(*part, *names).orderBy(*order)
    ranked = marked.withColumn("_rn", F.row_number().over(inner) - 1)
    return (
        ranked.join(offsets.select(*keep), [*part, *names])
        .withColumn(out, (F.col("_offset") + F.col("_rn")).cast("bigint"))
        .drop("_rn", "_offset", *names)
    )


def running_before(
    df: DataFrame,
    part: Sequence[str],
    block: str,
    order: Sequence[Column],
    values: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Running ``sum`` or ``max`` over all earlier rows of ``part``, own row excluded.

    ``values`` maps an output column to ``(kind, expression)``.  A sum over no rows is 0,
    a max over no rows is null.
    """
    part = list(part)
    fold = {"sum": F.sum, "max": F.max}
    local = Window.partitionBy(*part, block).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = df
    for name, (kind, expr) in values.items():
        rows = rows.withColumn(f"_v_{name}", expr)
        rows = rows.withColumn(f"_in_{name}", fold[kind](f"_v_{name}").over(before))

    edges = rows.groupBy(*part, block).agg(
        *[fold[kind](f"_v_{name}").alias(f"_b_{name}") for name, (kind, _) in values.items()]
    )
    across = Window.partitionBy(*part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *part,
        block,
        *[fold[kind](f"_b_{name}").over(across).alias(f"_pre_{name}") for name, (kind, _) in values.items()],
    )
    out = rows.join(edges, [*part, block])
    for name, (kind, _) in values.items():
        inside, pre = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        if kind == "sum":
            merged = F.coalesce(inside, F.lit(0)) + F.coalesce(pre, F.lit(0))
        else:
            merged = F.greatest(inside, pre)
        out = out.withColumn(name, merged).drop(f"_v_{name}", f"_in_{name}", f"_pre_{name}")
    return out


def with_neighbours(
    df: DataFrame, pos: str, before: int, after: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """Copy the rows near a block edge into the next block, so bounded frames see them.

    ``pos`` must be dense.  The result has ``_blk`` and ``_own``; put a window over
    ``(part, _blk)`` ordered by ``pos`` on it and keep the rows where ``_own``.
    """
    if max(before, after) >= block:
        raise ValueError("the frame must be smaller than a block")
    blk = block_of(pos, block)
    offset = F.col(pos) - blk * block

    def copy(number: Column, own: bool) -> Column:
        return F.struct(number.alias("blk"), F.lit(own).alias("own"))

    homes = [copy(blk, True)]
    if before:
        homes.append(F.when(offset >= block - before, copy(blk + 1, False)))
    if after:
        homes.append(F.when((offset < after) & (blk > 0), copy(blk - 1, False)))
    edge = F.lit(False)
    if before:
        edge = edge | (offset >= block - before)
    if after:
        edge = edge | (offset < after)
    spread = F.when(edge, F.array_compact(F.array(*homes))).otherwise(F.array(homes[0]))
    return (
        df.withColumn("_home", F.explode(spread))
        .withColumn("_blk", F.col("_home.blk"))
        .withColumn("_own", F.col("_home.own"))
        .drop("_home")
    )


def keep_evenly(rank: Column, total: Column, picks: Column) -> Column:
    """True for the rows an even stride of ``picks`` out of ``total`` keeps.

    The stride is ``max((total - 1) div (picks - 1), 1)``; the last row is added when the
    stride misses it, and the list is cut at ``picks``.  One pick takes the middle row.
    """
    step = F.greatest(
        F.floor((total - 1) / F.greatest(picks - 1, F.lit(1))).cast("bigint"), F.lit(1)
    )
    on_stride = (rank % step) == 0
    index = F.floor(rank / step).cast("bigint") + F.when(on_stride, 0).otherwise(1)
    strided = (on_stride | (rank == total - 1)) & (index < picks)
    return (
        F.when(picks <= 0, False)
        .when(total <= picks, True)
        .when(picks == 1, rank == F.floor(total / 2).cast("bigint"))
        .otherwise(strided)
    )


def top_rows(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each part; Spark cuts each map task to ``k`` before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
