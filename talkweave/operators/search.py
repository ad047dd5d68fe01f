"""Keyword (BM25) and vector search over batches of requests.

Tables in: ``corpus(workspace_id, message_id, text, ...)``, ``vectors(workspace_id,
message_id, person_id, embedding, ...)``; requests carry ``query_id``, ``workspace_id``
and what they search with.  Filters on person, speaker or date go on the tables before
they are searched, so the scan prunes them and top-k counts only what passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import tokens
from talkweave.plans.topk import (
    PACKED_REQUESTS,
    SCORE_DIGITS,
    BestRows,
    arrow_ids,
    ddl,
    local_topk,
    packed,
)
from talkweave.plans.ordered import top_rows

K1 = 1.5
B = 0.75
# Rows of term statistics, and numbers per matrix, that a task may hold.
PACKED_TERMS = 200_000
PACKED_NUMBERS = 20_000_000
# What the packed search works on at once, however many rows and words an Arrow batch has.
SCORED_NUMBERS = 1_000_000
RUN_TOKENS = 250_000
# Scores, and values of vectors, that the packed cosine search holds at once.
VECTOR_NUMBERS = 4_000_000
# Cells of the large-request path: requests and embedding values per cell.
CELL_REQUESTS = 2048
CELL_VALUES = 1 << 25


def unit_vector(v: Column) -> Column:
    """L2-normalised copy as doubles; a zero vector stays zero."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


# ---------------------------------------------------------------- BM25


def each_term(rows: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """One row per term.  The outer explode spares a size check, which Spark would push down
    to the scan and which would tokenise every text a second time."""
    return rows.select(*keep, F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull())


def tokenised(corpus: DataFrame) -> DataFrame:
    """``workspace_id, message_id, terms``: the input of index and search."""
    return corpus.select("workspace_id", "message_id", tokens(F.col("text")).alias("terms"))


def postings(token_table: DataFrame) -> DataFrame:
    """``workspace_id, term, message_id, tf, dl``.

    The token lists are placed by message before they are exploded, so the counts are
    taken where the rows already lie and the exploded rows are never shuffled.
    """
    placed = token_table.select(
        "workspace_id", "message_id", F.size("terms").cast("bigint").alias("dl"), "terms"
    ).repartition("message_id")
    exploded = each_term(placed, F.col("terms"), "workspace_id", "message_id", "dl")
    return exploded.groupBy("workspace_id", "term", "message_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def posting_stats(posting_table: DataFrame) -> DataFrame:
    """``workspace_id, term, df`` of an index: a posting is one message with the term."""
    return posting_table.groupBy("workspace_id", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(token_table: DataFrame) -> DataFrame:
    return token_table.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("docs"), F.avg(F.size("terms")).alias("avgdl")
    )


def idf(docs: Column, df: Column) -> Column:
    return F.log((docs - df + 0.5) / (df + 0.5) + 1.0)


def term_stats(token_table: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``workspace_id, term, df, idf, avgdl``, for all terms or those of ``vocabulary``.

    Document frequencies are summed on the map side first, so a word found in most
    documents arrives as one row per task.
    """
    seen = each_term(token_table, F.array_distinct("terms"), "workspace_id")
    if vocabulary is not None:
        seen = seen.join(vocabulary, ["workspace_id", "term"], "left_semi")
    counts = seen.groupBy("workspace_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(corpus_stats(token_table), "workspace_id").withColumn("idf", idf(F.col("docs"), F.col("df")))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, workspace_id, term``, each term once per query."""
    return each_term(queries, F.array_distinct(tokens(F.col("text"))), "query_id", "workspace_id")


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, message_id, score, rank`` of the best ``k`` messages with a positive score."""
    token_table = tokenised(corpus)
    terms = query_terms(queries)
    wanted = packed(
        terms.groupBy("query_id", "workspace_id").agg(F.collect_list("term").alias("terms")), PACKED_REQUESTS
    )
    if wanted is not None and sum(len(r.terms) for r in wanted) <= PACKED_TERMS:
        vocabulary = terms.select("workspace_id", "term").distinct()
        stats = packed(term_stats(token_table, vocabulary).select("workspace_id", "term", "idf", "avgdl"), PACKED_TERMS)
        if stats is not None and _fits(wanted, stats):
            return _bm25_packed(token_table, corpus, wanted, stats, k, ddl(queries.schema["query_id"]))
    return bm25_join(token_table, terms, k)


def _fits(wanted: list, stats: list) -> bool:
    """Both matrices of the packed search stay within their bound."""
    vocab, workspaces = len({r.term for r in stats}), len({r.workspace_id for r in stats})
    return vocab * max(len(wanted), workspaces) <= PACKED_NUMBERS


def _bm25_packed(token_table, corpus, wanted, stats, k, id_type) -> DataFrame:
    schema = f"query_id {id_type}, message_id {ddl(corpus.schema['message_id'])}, score double"
    spark = corpus.sparkSession
    workspaces = sorted({r.workspace_id for r in stats})
    vocab = sorted({r.term for r in stats})
    if not vocab:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    ws_at = {w: i for i, w in enumerate(workspaces)}
    term_at = {t: i for i, t in enumerate(vocab)}
    weights = np.zeros((len(workspaces), len(vocab)))
    avgdl = np.ones(len(workspaces))
    for r in stats:
        weights[ws_at[r.workspace_id], term_at[r.term]] = r.idf
        avgdl[ws_at[r.workspace_id]] = r.avgdl
    wanted = [r for r in wanted if r.workspace_id in ws_at]
    member = np.zeros((len(vocab), len(wanted)))
    for q, r in enumerate(wanted):
        for t in r.terms:
            if t in term_at:
                member[term_at[t], q] = 1.0
    scope = np.array([ws_at[r.workspace_id] for r in wanted])
    shared = spark.sparkContext.broadcast((workspaces, vocab, weights, avgdl, member, scope))
    rows_at_once = max(1, SCORED_NUMBERS // len(vocab))

    def score(batch: pa.RecordBatch):
        workspaces_, vocab_, weights_, avgdl_, member_, scope_ = shared.value
        scopes = codes(batch.column("workspace_id"), workspaces_)
        v = len(vocab_)
        wanted_ = {w: np.flatnonzero(scope_ == w) for w in np.unique(scopes[scopes >= 0])}
        members = {w: member_[:, asked] for w, asked in wanted_.items()}
        for start, stop in token_runs(batch.column("terms"), rows_at_once):
            lists = batch.column("terms").slice(start, stop - start)
            ws = scopes[start:stop]
            dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = codes(lists.flatten(), vocab_)
            known = np.flatnonzero(flat >= 0)
            row, term = np.repeat(np.arange(len(dl)), dl)[known], flat[known]
            for w in np.unique(ws[ws >= 0]):
                inside = ws == w
                mine = inside[row]
                here = np.flatnonzero(inside)
                place = np.cumsum(inside) - 1
                part = np.bincount(place[row[mine]] * v + term[mine], minlength=len(here) * v).reshape(len(here), v).astype(float)
                norm = K1 * (1 - B + B * dl[here] / avgdl_[w])
                below = part + norm[:, None]
                np.maximum(below, 1e-9, out=below)
                part *= weights_[w]
                part *= K1 + 1
                part /= below
                yield part @ members[w], start + here, wanted_[w]

    rows = token_table.select("message_id", "workspace_id", "terms")
    return local_topk(rows, score, arrow_ids([r.query_id for r in wanted], id_type), schema, k, minimum=0.0)


def token_runs(lists: pa.Array, rows: int) -> list[tuple[int, int]]:
    """Runs of at most ``rows`` lists and ``RUN_TOKENS`` tokens that cover ``lists``; a longer list is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    runs, start = [], 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + RUN_TOKENS, side="right"))
        stop = min(max(stop, start + 1), start + rows)
        runs.append((start, min(stop, len(ends))))
        start = runs[-1][1]
    return runs


def codes(values: pa.Array, known: list) -> np.ndarray:
    """Index of each value in ``known``, -1 where it is not there."""
    found = pc.fill_null(pc.index_in(values, value_set=pa.array(known)), -1)
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def bm25_join(token_table: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """BM25 for request sets too large to pack: postings joined with query terms.

    A frequent term is a hot join key on both sides, so postings are salted by message and
    the terms repeated once per salt; scores of a message are summed on the map side.
    """
    salts = 16
    stats = term_stats(token_table, terms.select("workspace_id", "term").distinct())
    salted_terms = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    posted = (
        postings(token_table)
        .join(stats.select("workspace_id", "term", "idf", "avgdl"), ["workspace_id", "term"])
        .withColumn("_salt", F.pmod(F.xxhash64("message_id"), F.lit(salts)).cast("int"))
    )
    tf, dl = F.col("tf").cast("double"), F.col("dl")
    weight = F.col("idf") * tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * dl / F.col("avgdl")), F.lit(1e-9))
    scored = (
        posted.withColumn("weight", weight)
        .join(salted_terms, ["workspace_id", "term", "_salt"])
        .groupBy("query_id", "message_id")
        .agg(F.round(F.sum("weight"), SCORE_DIGITS).alias("score"))
        .filter("score > 0")
    )
    return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("message_id")], k)


# ---------------------------------------------------------------- vectors


def scope_key(scope: Sequence[str]) -> Column:
    """One text for all rows that agree on every ``scope`` column and on the length of their vector.

    Null where a scope column is null or the vector is missing or empty: such a row meets nothing.
    """
    there = F.size("embedding") > 0
    for name in scope:
        there = there & F.col(name).isNotNull()
    return F.when(there, F.to_json(F.struct(F.size("embedding").alias("dims"), *scope)))


def cosine_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 8, scope: Sequence[str] = ("workspace_id",)
) -> DataFrame:
    """Exact cosine top-k: ``query_id, message_id, score, rank``.

    A request sees the vectors that agree with it on every ``scope`` column and have its length; null
    agrees with nothing.  The vectors stay where they are; only ``k`` rows per request leave a task.
    """
    key = scope_key(list(scope))
    rows = vectors.select("message_id", key.alias("_scope"), "embedding").filter("_scope is not null")
    asked = queries.select("query_id", key.alias("_scope"), "embedding").filter("_scope is not null")
    id_type = ddl(queries.schema["query_id"])
    schema = f"query_id {id_type}, message_id {ddl(vectors.schema['message_id'])}, score double"
    small = packed(asked, PACKED_REQUESTS)
    if small is None:
        return _cosine_cells(rows, asked, schema, k)
    if not small:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    members: dict[str, list[int]] = {}
    for at, r in enumerate(small):
        members.setdefault(r._scope, []).append(at)
    blocks = [(np.array(own), _unit(np.array([small[i].embedding for i in own], dtype=np.float64))) for own in members.values()]
    shared = vectors.sparkSession.sparkContext.broadcast((list(members), blocks))

    def score(batch: pa.RecordBatch):
        scopes_, blocks_ = shared.value
        row_scope = codes(batch.column("_scope"), scopes_)
        lists = batch.column("embedding")
        for code in np.unique(row_scope[row_scope >= 0]):
            here = np.flatnonzero(row_scope == code)
            wanted, matrix_ = blocks_[code]
            rows_at_once = max(1, VECTOR_NUMBERS // max(matrix_.shape))
            for start in range(0, len(here), rows_at_once):
                run = here[start : start + rows_at_once]
                yield _units(lists.take(pa.array(run)), matrix_.shape[1]) @ matrix_.T, run, wanted

    return local_topk(rows, score, arrow_ids([r.query_id for r in small], id_type), schema, k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _units(lists: pa.Array, dims: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(lists), dims))


def _cosine_cells(rows: DataFrame, asked: DataFrame, schema: str, k: int) -> DataFrame:
    """Requests beyond the packed bound: each scope becomes a grid of bounded cells.

    The rows of a scope are cut so that a cell holds at most ``CELL_VALUES`` numbers, its
    requests into runs of ``CELL_REQUESTS``; a cell multiplies its two blocks and emits
    ``k`` rows per request, never its pairs.
    """
    grid = (
        rows.groupBy("_scope").agg(F.sum(F.size("embedding")).alias("_r"))
        .join(asked.groupBy("_scope").agg(F.count(F.lit(1)).alias("_q")), "_scope")
        .select(
            "_scope",
            F.ceil(F.col("_r") / CELL_VALUES).alias("_rb"),
            F.ceil(F.col("_q") / CELL_REQUESTS).alias("_qb"),
        )
    )

    def place(df: DataFrame, ident: str, own: str, other: str, own_cell: str, other_cell: str) -> DataFrame:
        return (
            df.join(grid, "_scope")
            .withColumn(own_cell, F.pmod(F.xxhash64(ident), F.col(own)))
            .withColumn(other_cell, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
            .select(ident, "_scope", "_rc", "_qc", "embedding")
        )

    left = place(rows, "message_id", "_rb", "_qb", "_rc", "_qc").groupBy("_scope", "_rc", "_qc")
    right = place(asked, "query_id", "_qb", "_rb", "_qc", "_rc").groupBy("_scope", "_rc", "_qc")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        empty = pa.table(
            {"query_id": b["query_id"].slice(0, 0), "message_id": a["message_id"].slice(0, 0), "score": pa.array([], pa.float64())}
        )
        if not a.num_rows or not b.num_rows:
            return empty
        questions = b["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
        matrix = _unit(questions)
        best = BestRows(b.num_rows, k)
        ids = a["message_id"].to_numpy()
        if ids.dtype == object:
            ids = ids.astype(str)
        every = np.arange(b.num_rows)
        for lo in range(0, a.num_rows, 8192):
            piece = a["embedding"].slice(lo, 8192).combine_chunks()
            best.add(_units(piece, matrix.shape[1]) @ matrix.T, ids[lo : lo + 8192], every)
        out = best.batch(b["query_id"].combine_chunks(), a["message_id"].type)
        return empty if out is None else pa.Table.from_batches([out])

    found = left.cogroup(right).applyInArrow(cell, schema)
    return top_rows(found, ["query_id"], [F.col("score").desc(), F.col("message_id")], k)


# ---------------------------------------------------------------- approximate vectors


def with_bucket(vectors: DataFrame, dims: int, bits: int = 6, seed: int = 7) -> DataFrame:
    """Add ``bucket``: the sign pattern of ``bits`` random projections of the embedding.

    Write the table partitioned by ``bucket`` and a search reads only the buckets it probes.
    """
    planes = np.random.default_rng(seed).standard_normal((bits, dims))
    signs = [
        F.when(
            F.aggregate(
                F.zip_with(
                    F.col("embedding").cast("array<double>"), F.lit(plane.tolist()), lambda a, b: a * b
                ),
                F.lit(0.0),
                lambda a, x: a + x,
            )
            >= 0,
            1 << i,
        ).otherwise(0)
        for i, plane in enumerate(planes)
    ]
    return vectors.withColumn("bucket", sum(signs[1:], signs[0]).cast("int"))


def ann_topk(vectors: DataFrame, queries: DataFrame, k: int, dims: int, bits: int = 6, probes: int = 22) -> DataFrame:
    """Approximate top-k: exact scores over the buckets nearest to each request.

    ``probes`` buckets are tried per request in order of differing bits.  Rows of other
    buckets are dropped before any scoring.
    """
    ranked = with_bucket(queries, dims, bits)
    every = np.arange(1 << bits)
    near = sorted(every.tolist(), key=lambda b: (bin(b).count("1"), b))[:probes]
    flips = F.array(*[F.lit(int(b)) for b in near])
    probed = ranked.withColumn("bucket", F.explode(F.transform(flips, lambda f: F.col("bucket").bitwiseXOR(f))))
    stored = with_bucket(vectors, dims, bits)
    kept = stored.join(probed.select("bucket").distinct(), "bucket", "left_semi")
    scoped = kept.withColumn("workspace_id", F.col("bucket").cast("string"))
    asked = probed.withColumn("workspace_id", F.col("bucket").cast("string")).select("query_id", "workspace_id", "embedding")
    found = cosine_topk(scoped, asked, k).drop("rank")
    return top_rows(found, ["query_id"], [F.col("score").desc(), F.col("message_id")], k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    hit = approximate.select("query_id", "message_id", F.lit(1).alias("found"))
    return exact.join(hit, ["query_id", "message_id"], "left").agg(
        (F.sum(F.coalesce("found", F.lit(0))) / F.count(F.lit(1))).alias("recall")
    )

