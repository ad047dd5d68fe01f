"""Exact top-k of many requests over a large table.

A packed request side (bounded, checked by count) travels to every task; each task scores
its rows in Arrow batches against all requests at once and keeps ``k`` rows per request,
so no request-row pair is ever shuffled.  A request side beyond the bound is cut into
cells instead (see ``search.cosine_topk``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.plans.ordered import top_rows

SCORE_DIGITS = 9
# Requests one task keeps in memory; beyond it the request side is not packed.
PACKED_REQUESTS = 4096


def packed(df: DataFrame, limit: int) -> list | None:
    """Rows of a small table, or None when it has more than ``limit``."""
    rows = df.take(limit + 1)
    return None if len(rows) > limit else rows


class BestRows:
    """Running best ``k`` rows of each request: score descending, id ascending."""

    def __init__(self, requests: int, k: int, minimum: float | None = None):
        self.k = k
        self.minimum = minimum
        self.scores: list[np.ndarray] = [np.empty(0)] * requests
        self.ids: list[np.ndarray | None] = [None] * requests

    def add(self, scores: np.ndarray, ids: np.ndarray, requests: np.ndarray) -> None:
        """``scores`` is rows x requests; ``requests`` numbers its columns."""
        scores = np.round(scores, SCORE_DIGITS)
        floor = -np.inf if self.minimum is None else self.minimum
        for at, q in enumerate(requests):
            column = scores[:, at]
            full = len(self.scores[q]) >= self.k
            bar = max(floor, self.scores[q][-1]) if full else floor
            hit = np.flatnonzero((column >= bar) & (column > floor))
            if not len(hit):
                continue
            if len(hit) > self.k:
                top = np.partition(column[hit], len(hit) - self.k)[len(hit) - self.k]
                hit = hit[column[hit] >= top]
            merged = np.concatenate([self.scores[q], column[hit]])
            names = ids[hit] if self.ids[q] is None else np.concatenate([self.ids[q], ids[hit]])
            order = np.lexsort((names, -merged))[: self.k]
            self.scores[q], self.ids[q] = merged[order], names[order]

    def batch(self, request_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch | None:
        sizes = [len(s) for s in self.scores]
        if not sum(sizes):
            return None
        index = np.repeat(np.arange(len(sizes)), sizes)
        ids = np.concatenate([i for i in self.ids if i is not None])
        return pa.RecordBatch.from_arrays(
            [request_ids.take(pa.array(index)), pa.array(ids, id_type), pa.array(np.concatenate(self.scores))],
            names=["query_id", "message_id", "score"],
        )


def local_topk(
    rows: DataFrame,
    score: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]],
    request_ids: pa.Array,
    schema: str,
    k: int,
    minimum: float | None = None,
) -> DataFrame:
    """Top ``k`` per request of every partition, then of the whole table.

    ``score`` yields ``(scores, rows, requests)`` for the pieces of a batch that share a scope.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(len(request_ids), k, minimum)
        id_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("message_id")
            id_type = column.type
            ids = column.to_numpy(zero_copy_only=False)
            if id_type in (pa.string(), pa.large_string()):
                ids = ids.astype(str)
            for scores, rows_, requests in score(batch):
                best.add(scores, ids[rows_], requests)
        out = None if id_type is None else best.batch(request_ids, id_type)
        if out is not None:
            yield out

    found = rows.mapInArrow(run, schema)
    return top_rows(found, ["query_id"], [F.col("score").desc(), F.col("message_id")], k)


def ddl(field) -> str:
    return field.dataType.simpleString()


ARROW_IDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def arrow_ids(values: list, kind: str) -> pa.Array:
    """Request ids in the type that their column has."""
    return pa.array(values, ARROW_IDS.get(kind))
