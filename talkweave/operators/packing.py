"""Packing messages into chunks under a count and a token limit.

Packing is greedy: a chunk closes when the next message would break a limit, so where a
chunk starts depends on all chunks before it.  The dependency is short, though: no chunk is
longer than ``max_items``, so a block of rows is fully described by where a chunk entering
at each of its first ``max_items`` rows leaves it.  Blocks are described in parallel, the
descriptions are chained (first inside runs of blocks, then over the runs), and each block
is cut with its entry known.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.plans.ordered import block_of, running_before, with_neighbours
from talkweave.plans.topk import ddl
from talkweave.schema import BLOCK_ROWS

RUN_BLOCKS = 1024


def next_starts(tokens: np.ndarray, rows: int, max_items: int, max_tokens: int) -> np.ndarray:
    """For each of the first ``rows`` rows, the row where a chunk begun there must end."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    first = np.arange(rows)
    by_tokens = np.searchsorted(upto[1:], upto[first] + max_tokens, side="right")
    return np.minimum(np.maximum(by_tokens, first + 1), first + max_items)


def block_exits(tokens: np.ndarray, rows: int, max_items: int, max_tokens: int) -> np.ndarray:
    """Offset in the next block of the first chunk after each possible entry row."""
    jump = next_starts(tokens, rows, max_items, max_tokens).tolist()
    leave = [0] * rows
    for i in range(rows - 1, -1, -1):
        leave[i] = jump[i] - rows if jump[i] >= rows else leave[jump[i]]
    return np.array(leave[: min(rows, max_items)])


def pack(
    items: DataFrame,
    part: Sequence[str],
    max_items: int = 200,
    max_tokens: int = 30_000,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``chunk_no`` to ``items``: part columns, dense ``pos`` in packing order, ``tokens``."""
    part = list(part)
    names = ", ".join(f"{c} {ddl(items.schema[c])}" for c in part)
    slim = items.select(*part, "pos", F.col("tokens").cast("bigint").alias("tokens"))
    near = with_neighbours(slim, "pos", 0, max_items, block)

    def describe(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        rows = int(frame["_own"].sum())
        out = frame.iloc[:1][[*part, "_blk"]].copy()
        out["exits"] = [block_exits(frame["tokens"].to_numpy(), rows, max_items, max_tokens).tolist()]
        return out

    exits = near.groupBy(*part, "_blk").applyInPandas(describe, f"{names}, _blk bigint, exits array<bigint>")
    exits = exits.withColumn("_run", F.floor(F.col("_blk") / RUN_BLOCKS).cast("bigint"))

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        """Exits of a whole run of blocks for each entry of its first block."""
        maps = list(frame.sort_values("_blk")["exits"])
        at = np.asarray(maps[0])
        for step in maps[1:]:
            at = np.asarray(step)[np.minimum(at, len(step) - 1)]
        out = frame.iloc[:1][[*part, "_run"]].copy()
        out["exits"] = [at.tolist()]
        return out

    def enter_runs(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_run")
        entries, at = [], 0
        for step in frame["exits"]:
            entries.append(at)
            at = int(step[min(at, len(step) - 1)])
        return frame[[*part, "_run"]].assign(run_entry=entries)

    def enter_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_blk")
        entries, at = [], int(frame["run_entry"].iloc[0])
        for step in frame["exits"]:
            entries.append(at)
            at = int(step[min(at, len(step) - 1)])
        return frame[[*part, "_blk"]].assign(entry=entries)

    runs = exits.groupBy(*part, "_run").applyInPandas(chain, f"{names}, _run bigint, exits array<bigint>")
    run_entries = runs.groupBy(*part).applyInPandas(enter_runs, f"{names}, _run bigint, run_entry bigint")
    entries = (
        exits.join(run_entries, [*part, "_run"])
        .groupBy(*part, "_run")
        .applyInPandas(enter_blocks, f"{names}, _blk bigint, entry bigint")
    )

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        rows = int(frame["_own"].sum())
        jump = next_starts(frame["tokens"].to_numpy(), rows, max_items, max_tokens)
        starts = np.zeros(rows, dtype=np.int64)
        at = int(frame["entry"].iloc[0])
        while at < rows:
            starts[at] = 1
            at = int(jump[at])
        own = frame.iloc[:rows]
        return own[[*part, "pos"]].assign(starts=starts)

    marked = (
        near.join(entries, [*part, "_blk"])
        .groupBy(*part, "_blk")
        .applyInPandas(cut, f"{names}, pos bigint, starts bigint")
        .withColumn("_blk", block_of("pos", block))
    )
    counted = running_before(marked, part, "_blk", [F.col("pos")], {"_before": ("sum", F.col("starts"))})
    numbers = counted.select(*part, "pos", (F.col("_before") + F.col("starts") - 1).alias("chunk_no"))
    return items.join(numbers, [*part, "pos"])
