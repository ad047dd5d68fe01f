"""A stored BM25 index and searches that read only it.

The messages of a workspace are dealt into ranges: by length, as short messages score highest, then by a hash.  A
posting holds the count of a term in a message and the message's length, small numbers that pack well.  Postings of one
term and range are one row, a block, with the largest share of a score (``top``) beside it; a range, and so a
block, holds about ``RANGE_MESSAGES`` messages, or fewer long ones.  Files are cut into buckets of terms and sorted by term,
so a search opens the buckets of its terms and skips row groups of others.

A search reads the block heads first: their sizes add up to the ``idf`` of its terms, the only statistics it needs, and
the sum of ``idf`` times ``top`` over the terms of a query bounds every message of a range.  The ranges with
the best bounds are scored; the k-th score found there is a bar, and only ranges whose bound reaches it are scored as
well.  A range is scored in one task for all queries that ask it, and ``k`` rows per query leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators.search import B, K1, idf, query_terms, tokenised
from talkweave.plans.ordered import top_rows
from talkweave.plans.topk import SCORE_DIGITS, ddl, packed
from talkweave.session import materialise

RANGE_MESSAGES = 4096
RANGE_TOKENS = 1 << 20
BUCKETS, BUCKET_FILES = 64, 8
FIRST_RANGES = 2
# Rows of statistics that may travel to every task.
SMALL_STATS = 100_000
# Sums of weights may differ in the last digits; a bound must not fall below what it bounds.
SLACK = 1e-6
_RANGE = ["workspace_id", "band", "part"]


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _band(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * 2).cast("int")


def bounded(small: DataFrame) -> DataFrame:
    """``small``, marked for broadcast if its rows may travel to every task."""
    return F.broadcast(small) if packed(small, SMALL_STATS) is not None else small


def length_stats(token_table: DataFrame) -> DataFrame:
    """``workspace_id, band, docs, sized, words, parts``, one row per workspace and band of lengths.

    ``parts`` is into how many ranges its messages are dealt.  Few rows, kept, as what follows reads them several times.
    """
    length = F.size("terms")
    found = token_table.groupBy("workspace_id", _band(F.coalesce(length, F.lit(0))).alias("band")).agg(
        F.count(F.lit(1)).alias("docs"), F.count(length).alias("sized"), F.coalesce(F.sum(length), F.lit(0)).alias("words")
    )
    parts = F.ceil(F.greatest(F.col("docs") / RANGE_MESSAGES, F.col("words") / RANGE_TOKENS))
    return materialise(found.withColumn("parts", parts))


def workspace_stats(lengths: DataFrame) -> DataFrame:
    """``workspace_id, docs, avgdl`` as ``corpus_stats`` finds them, from ``length_stats``."""
    return lengths.groupBy("workspace_id").agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("sized")).alias("avgdl"))


def dealt(token_table: DataFrame, lengths: DataFrame) -> DataFrame:
    """``workspace_id, band, part, message_id, words``: every message in its range, its terms joined by spaces.

    Nothing here filters by length, as Spark would tokenise every text once more for it.
    """
    length = F.coalesce(F.size("terms"), F.lit(0))
    rows = token_table.filter("workspace_id is not null").select(
        "workspace_id", "message_id", F.array_join("terms", " ").alias("words"), _band(length).alias("band")
    )
    placed = rows.join(bounded(lengths.select("workspace_id", "band", "parts")), ["workspace_id", "band"], "left")
    return placed.select(*_RANGE[:2], F.pmod(F.xxhash64("message_id"), F.col("parts")).alias("part"), "message_id", "words")


def _postings_of(whole: bool):
    """Postings of one range: a row per term with its messages, or with their number alone."""

    def run(held: pa.Table) -> pa.Table:
        ids = held.column("message_id").combine_chunks()
        lists = pc.split_pattern(pc.fill_null(held.column("words").combine_chunks(), ""), " ")
        words = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        words, row = words.filter(pa.array(there)), row[there]
        coded = words.dictionary_encode()
        # Rows of one message and length are one message, however often it was handed over.
        length = np.bincount(row, minlength=len(lists))
        names = ids.dictionary_encode(null_encoding="encode")
        place = np.empty(len(names.dictionary), np.int64)
        place[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(names.dictionary))
        pairs = np.stack([place[names.indices.to_numpy()], length])
        keys, first, message = np.unique(pairs[0] * (length.max(initial=0) + 1) + pairs[1], return_index=True, return_inverse=True)
        n = max(len(keys), 1)
        found, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + message[row], return_counts=True)
        term, at = found // n, first[found % n]
        size = np.bincount(term, minlength=len(coded.dictionary))
        out = {name: pa.repeat(held.column(name)[0], len(size)) for name in _RANGE} | {"term": coded.dictionary, "size": pa.array(size, pa.int32())}
        if whole:
            edges = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            values = {"ids": ids.take(pa.array(at)), "tfs": pa.array(tf, pa.int32()), "dls": pa.array(length[at], pa.int32())}
            out |= {name: pa.ListArray.from_arrays(edges, held_) for name, held_ in values.items()}
        return pa.table(out)

    return run


def range_postings(messages: DataFrame) -> DataFrame:
    """``workspace_id, band, part, term, size, ids, tfs, dls`` of ``dealt`` messages: one row per term and range.

    A range is bounded, so its terms are counted in one piece, and no row per word is made or shuffled.
    """
    id_type = ddl(messages.schema["message_id"])
    heads = "workspace_id string, band int, part bigint, term string, size int"
    return messages.groupBy(*_RANGE).applyInArrow(_postings_of(True), f"{heads}, ids array<{id_type}>, tfs array<int>, dls array<int>")


def term_counts(messages: DataFrame) -> DataFrame:
    """``workspace_id, term, df`` of ``dealt`` messages, from the sizes of their postings; the same shuffle serves both."""
    sizes = messages.groupBy(*_RANGE).applyInArrow(_postings_of(False), "workspace_id string, band int, part bigint, term string, size int")
    return sizes.groupBy("workspace_id", "term").agg(F.sum("size").alias("df"))


def counted_postings(token_table: DataFrame) -> DataFrame:
    """``range_postings`` with ``df, idf, avgdl`` of their terms.

    A term of very many messages is one row of the counts and as many rows of the postings as it has ranges.
    """
    lengths = length_stats(token_table)
    messages = dealt(token_table, lengths)
    stats = term_counts(messages).join(bounded(workspace_stats(lengths)), "workspace_id")
    stats = stats.select("workspace_id", "term", "df", idf(F.col("docs"), F.col("df")).alias("idf"), "avgdl")
    return range_postings(messages).join(stats, ["workspace_id", "term"])


def share(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a posting adds to a score, but for the ``idf`` of its term."""
    return tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * dl / avgdl), F.lit(1e-9))


def index_blocks(corpus: DataFrame) -> DataFrame:
    """``workspace_id, band, part, term, bucket, top, size, docs, avgdl, ids, tfs, dls``: one row per term and range.

    ``docs`` and ``avgdl`` are those of the workspace; as columns of equal values they take no room in a file.  Rows come
    dealt to files, which is the only shuffle of postings: ``top`` and ``size`` are found behind it.
    """
    token_table = tokenised(corpus.filter("workspace_id is not null and message_id is not null"))
    lengths = length_stats(token_table)
    posted = range_postings(dealt(token_table, lengths)).drop("size")
    known = posted.join(bounded(workspace_stats(lengths)), "workspace_id").withColumn("bucket", term_bucket(F.col("term")))
    placed = known.repartition("bucket", F.pmod(F.xxhash64(*_RANGE), F.lit(BUCKET_FILES)))
    shares = F.zip_with("tfs", "dls", lambda tf, dl: share(tf.cast("double"), dl, F.col("avgdl")))
    return placed.select(
        *_RANGE, "term", "bucket", F.array_max(shares).alias("top"), F.size("ids").alias("size"), "docs", "avgdl", "ids", "tfs", "dls"
    )


def write_index(corpus: DataFrame, path: str) -> None:
    """Index ``corpus(workspace_id, message_id, text)``; rows without workspace or id, and empty texts, have no postings.

    Message ids are unique within a workspace.
    """
    blocks = index_blocks(corpus).sortWithinPartitions("bucket", "term", "workspace_id", "band", "part")
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Index:
    """A written index; ``search`` can be handed to operators in place of a corpus search.

    ``id_type`` is the type of the message ids that were indexed.
    """

    spark: SparkSession
    path: str
    id_type: str = "bigint"

    def blocks(self) -> DataFrame:
        heads = "workspace_id string, band int, part bigint, term string, top double, size int, docs bigint, avgdl double, bucket int"
        return self.spark.read.schema(f"{heads}, ids array<{self.id_type}>, tfs array<int>, dls array<int>").parquet(self.path)

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return index_topk(self.blocks(), queries, k)


_TERM = ["bucket", "workspace_id", "term"]


def weighted(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, workspace_id, term, bucket, idf, avgdl`` of the terms that the index holds, from its block heads."""
    if "idf" in terms.columns:
        return terms
    terms = terms.withColumn("bucket", term_bucket(F.col("term")))
    heads = blocks.join(bounded(terms.select(*_TERM).distinct()), _TERM, "left_semi")
    counts = heads.groupBy(*_TERM).agg(F.sum("size").alias("df"), F.first("docs").alias("docs"), F.first("avgdl").alias("avgdl"))
    return terms.join(counts.select(*_TERM, idf(F.col("docs"), F.col("df")).alias("idf"), "avgdl"), _TERM)


def asked_ranges(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, workspace_id, band, part, bound, postings``: what a query may find in each range.

    Reads the block heads only: no ids, no counts.
    """
    terms = weighted(blocks, terms)
    met = blocks.select(*_RANGE, "term", "bucket", "top", "size").join(bounded(terms), _TERM)
    bound = F.sum(F.greatest(F.col("idf") * F.col("top"), F.lit(0.0))) + SLACK
    return met.groupBy("query_id", *_RANGE).agg(bound.alias("bound"), F.sum("size").alias("postings"))


def _scored(id_type: pa.DataType, query_type: pa.DataType, k: int):
    """Best ``k`` messages of every query in one range."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], query_type), "message_id": pa.array([], id_type), "score": pa.array([], pa.float64())})
        if not held.num_rows or not asked.num_rows:
            return empty
        lists = held.column("ids").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(names.astype(str) if names.dtype == object else names, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[coded.indices.to_numpy()]
        tf, dl = (held.column(c).combine_chunks().flatten().to_numpy().astype(float) for c in ("tfs", "dls"))
        edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        rows = {term: (edges[i], edges[i + 1]) for i, term in enumerate(held.column("term").to_pylist())}
        avgdl = asked.column("avgdl")[0].as_py()
        shares = tf * (K1 + 1) / np.maximum(tf + K1 * (1 - B + B * dl / avgdl), 1e-9)
        terms: dict = {}
        for query, term, idf_ in zip(*(asked.column(c).to_pylist() for c in ("query_id", "term", "idf")), strict=True):
            terms.setdefault(query, []).append((term, idf_))
        queries, found, scores = [], [], []
        for query, own in terms.items():
            total = np.zeros(len(order))
            for term, idf_ in sorted(own):
                if term in rows:
                    low, high = rows[term]
                    total[at[low:high]] += idf_ * shares[low:high]
            total = np.round(total, SCORE_DIGITS)
            best = np.argsort(-total, kind="stable")[:k]
            best = best[total[best] > 0]
            queries += [query] * len(best)
            found.append(order[best])
            scores.append(total[best])
        ids = coded.dictionary.take(pa.array(np.concatenate(found), pa.int64()))
        return pa.table({"query_id": pa.array(queries, query_type), "message_id": ids.cast(id_type), "score": pa.array(np.concatenate(scores))})

    return run


_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def score_ranges(blocks: DataFrame, terms: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """``query_id, message_id, score``: at most ``k`` rows of every query and range.

    Blocks of other terms are left where they lie; what is shuffled is the blocks of the terms, once, by their range.
    """
    terms = weighted(blocks, terms)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    query_type = ddl(terms.schema["query_id"])
    asked = ranges.select("query_id", *_RANGE).join(bounded(terms), ["query_id", "workspace_id"])
    held = blocks.join(bounded(terms.select(*_TERM).distinct()), _TERM, "left_semi").join(ranges.select(*_RANGE).distinct(), _RANGE, "left_semi")
    held = held.select(*_RANGE, "term", "ids", "tfs", "dls")
    anew = asked.select(*[F.col(c).alias(c) for c in (*_RANGE, "query_id", "term", "idf", "avgdl")])
    pairs = held.groupBy(*_RANGE).cogroup(anew.groupBy(*_RANGE))
    return pairs.applyInArrow(_scored(_ARROW[id_type], _ARROW[query_type], k), f"query_id {query_type}, message_id {id_type}, score double")


def index_topk(blocks: DataFrame, queries: DataFrame, k: int = 20, first: int = FIRST_RANGES) -> DataFrame:
    """``query_id, message_id, score, rank`` of the best ``k`` messages with a positive score.

    ``queries``: ``query_id, workspace_id, text``; a query id lies in one workspace.  The same rows as a search of the
    corpus that was indexed.
    """
    terms = materialise(weighted(blocks, query_terms(queries)))
    ranges = asked_ranges(blocks, terms)
    order = [F.col("bound").desc(), F.col("band"), F.col("part")]
    best = top_rows(ranges, ["query_id"], order, first).drop("rank")
    near = score_ranges(blocks, terms, best, k)
    kth = top_rows(near, ["query_id"], [F.col("score").desc(), F.col("message_id")], k)
    bar = kth.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    rest = open_ranges(ranges, best, bar)
    return top_rows(near.unionByName(score_ranges(blocks, terms, rest, k)), ["query_id"], [F.col("score").desc(), F.col("message_id")], k)


def open_ranges(ranges: DataFrame, scored: DataFrame, bar: DataFrame) -> DataFrame:
    """Ranges not scored yet whose bound reaches the bar of their query; a tie does, as ids decide it."""
    left = ranges.join(scored.select("query_id", *_RANGE), ["query_id", *_RANGE], "left_anti")
    return left.join(bar, "query_id", "left").filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))).drop("bar")
