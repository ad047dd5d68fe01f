"""Approximate vector search over stored cells: coarse centroids, residual codes, exact scores of the best.

Vectors are scaled to length one.  ``train`` fits centroids, and for each slice of the dimensions a book of residuals,
by k-means on a bounded sample (``SAMPLE_NUMBERS`` numbers, chosen by a hash of the id); every vector is stored, in the
cell of its nearest centroid, with one byte per slice that names its nearest residual.  A cell is stored in parts of
about ``PART_ROWS`` rows.

A search opens the ``probes`` cells nearest to each query, and no other files.  A part scores its rows for all queries
that ask it by adding up a table of products per slice, and scores the best ``depth`` of each query again exactly;
``k`` rows per query leave it.  What the codes or the choice of cells may lose is measured by ``search.recall``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.plans.ordered import top_rows
from talkweave.plans.topk import ARROW_IDS, SCORE_DIGITS, ddl

SAMPLE_NUMBERS = 1 << 22
PART_ROWS = 1 << 16
MAX_CELLS = 4096
CODES = 256
ROUNDS = 12


@dataclass(frozen=True)
class Codebook:
    """``centroids`` is cells x dimensions; ``books`` slices x codes x dimensions of a slice, or None for exact scores."""

    centroids: np.ndarray
    books: np.ndarray | None = None

    def nearest(self, units: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` best cells of each vector, best first; ties go to the smaller cell."""
        return np.argsort(-np.round(units @ self.centroids.T, SCORE_DIGITS), axis=1, kind="stable")[:, :n]

    def codes(self, units: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (units - self.centroids[cell]).reshape(len(units), len(self.books), -1)
        return np.stack([_nearest(rest[:, s], book) for s, book in enumerate(self.books)], axis=1).astype(np.uint8)


def _units(values: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, norm, out=np.zeros_like(values), where=norm > 0)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None] - 2 * rows @ centres.T, axis=1)


def _k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(rows, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def train(vectors: DataFrame, cells: int | None = None, slices: int | None = None, seed: int = 7) -> Codebook:
    """Fit a codebook; ``cells`` is by default the square root of the number of vectors, at most ``MAX_CELLS``."""
    there = vectors.filter(F.size("embedding") > 0)
    n, dims = there.select(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return Codebook(np.zeros((1, 1)))
    sample = there.select("embedding", F.xxhash64("message_id").alias("h")).orderBy("h").limit(max(1, SAMPLE_NUMBERS // dims))
    rows = _units(np.array([r["embedding"] for r in sample.drop("h").collect()], dtype=np.float64))
    cells = min(cells or int(np.ceil(np.sqrt(n))), MAX_CELLS)
    coarse = Codebook(_k_means(rows, cells, seed))
    width = next(w for w in (4, 3, 2, 1) if dims % w == 0) if slices is None else dims // slices
    rest = (rows - coarse.centroids[coarse.nearest(rows)[:, 0]]).reshape(len(rows), dims // width, width)
    return replace(coarse, books=np.stack([_padded(_k_means(rest[:, s], CODES, seed + s)) for s in range(dims // width)]))


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], CODES - len(book), axis=0)])


def _matrix(lists: pa.Array) -> np.ndarray:
    return _units(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))


def with_cells(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``vectors`` with ``cell`` and ``code``; rows whose vector has another length than the codebook are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    kept = vectors.filter(F.size("embedding") == book.centroids.shape[1])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                units = _matrix(batch.column("embedding"))
                cell = shared.value.nearest(units)[:, 0]
                codes = [None] * len(cell) if shared.value.books is None else [c.tobytes() for c in shared.value.codes(units, cell)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(codes, pa.binary())], [*batch.schema.names, "cell", "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, cell int, code binary")


def write_cells(vectors: DataFrame, book: Codebook, path: str) -> None:
    """Store ``vectors(message_id, embedding, ...)`` by cell and part."""
    placed = with_cells(vectors, book)
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("_parts"))
    split = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("message_id"), F.col("_parts")).cast("int"))
    split.drop("_parts").repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(path)


def probed_cells(queries: DataFrame, book: Codebook, probes: int) -> DataFrame:
    """``query_id, cell, embedding, scope columns``: one row per query and cell that it opens."""
    shared = queries.sparkSession.sparkContext.broadcast(book)
    kept = queries.filter(F.size("embedding") == book.centroids.shape[1])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.nearest(_matrix(batch.column("embedding")), probes)
                take = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns], pa.array(cells.ravel(), pa.int32())], [*batch.schema.names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, cell int")


def _best(book, id_type: pa.DataType, query_type: pa.DataType, k: int, depth: int):
    """Best ``k`` rows of one part for every query that opens it."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], query_type), "message_id": pa.array([], id_type), "score": pa.array([], pa.float64())})
        if not held.num_rows or not asked.num_rows:
            return empty
        units, questions = (_matrix(t.column("embedding").combine_chunks()) for t in (held, asked))
        ids = held.column("message_id").combine_chunks()
        names = ids.to_numpy(zero_copy_only=False)
        names = names.astype(str) if names.dtype == object else names
        scope, wanted = (np.array(t.column("_scope").to_pylist()) for t in (held, asked))
        rough, books = None, book.value.books
        if books is not None:
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(units), -1)
            tables = np.einsum("qsw,scw->qsc", questions.reshape(len(questions), len(books), -1), books)
            rough = lambda q, rows: tables[q][np.arange(len(books)), codes[rows]].sum(axis=1)
        queries, rows_of, scores = [], [], []
        for q, name in enumerate(asked.column("query_id").to_pylist()):
            rows = np.flatnonzero(scope == wanted[q])
            if rough is not None and len(rows) > depth:
                rows = rows[np.argpartition(-rough(q, rows), depth - 1)[:depth]]
            exact = np.round(units[rows] @ questions[q], SCORE_DIGITS)
            order = np.lexsort((names[rows], -exact))[:k]
            queries += [name] * len(order)
            rows_of.append(rows[order])
            scores.append(exact[order])
        found = ids.take(pa.array(np.concatenate(rows_of), pa.int64()))
        return pa.table({"query_id": pa.array(queries, query_type), "message_id": found.cast(id_type), "score": pa.array(np.concatenate(scores))})

    return run


def cell_topk(stored: DataFrame, queries: DataFrame, book: Codebook, k: int = 8, probes: int = 8, depth: int | None = None, scope: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """``query_id, message_id, score, rank`` from the cells nearest to each query.

    A query sees the vectors that agree with it on every ``scope`` column; null agrees with nothing.  ``depth`` rows of a
    part are scored exactly (``8 * k`` by default), all of them where the codebook has no residuals.
    """
    key = F.to_json(F.struct(*scope))
    there = " and ".join(f"`{c}` is not null" for c in scope) or "true"
    asked = probed_cells(queries.filter(there).select("query_id", "embedding", key.alias("_scope")), book, probes)
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most the number of centroids
    rows = stored.filter(there).filter(F.col("cell").isin(cells)).select("message_id", "embedding", "code", key.alias("_scope"), "cell", "part")
    parts = stored.filter(F.col("cell").isin(cells)).select("cell", "part").distinct()
    spread = asked.join(parts, "cell").select("query_id", "embedding", "_scope", *[F.col(c).alias(c) for c in ("cell", "part")])
    id_type, query_type = ddl(stored.schema["message_id"]), ddl(queries.schema["query_id"])
    run = _best(stored.sparkSession.sparkContext.broadcast(book), ARROW_IDS[id_type], ARROW_IDS[query_type], k, depth or 8 * k)
    found = rows.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(run, f"query_id {query_type}, message_id {id_type}, score double")
    return top_rows(found, ["query_id"], [F.col("score").desc(), F.col("message_id")], k)
