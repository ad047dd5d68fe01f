"""Benchmark passages in training documents, by a positional inverted index.

Terms are runs of digits, lower-cased A-Z and characters above U+007F.  Every run of ``width`` terms of a benchmark item
is a window (a shorter item is one window).  Term frequencies of the benchmark's vocabulary are counted over all
training documents; the rarest term of each window is its anchor.  The index stores the positions of anchor terms in
the training documents, each with the terms next to it.  A posting and an anchor of the same term give the offset at
which the document would hold the item; the terms on both sides are then intersected at the same offset, which
yields the exact run around the posting.  Anchors of one item that fall within ``slop`` of the same offset without an
exact window are proximity matches.

Everything is DataFrame work.  The benchmark's terms are broadcast when their bytes are within ``BROADCAST_BYTES``;
beyond it the joins are ordinary ones.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.rows import col, cut, identified, written

WIDTH = 10
BROADCAST_BYTES = 16 << 20
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EXTRA_ANCHORS = 3


def terms(text: Column) -> Column:
    # On ASCII alone ``lower`` does the same as the slower ``translate``.
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    # Splitting takes a fraction of the time that extracting each term does; ends of a text that are no term leave empty strings.
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN_TERMS), ""), F.array().cast("array<string>"))


def is_small(small: DataFrame, text: str) -> bool:
    """The bytes of column ``text``, and 64 for each row, are within the bound of a broadcast."""
    return (small.select(F.sum(F.octet_length(text) + F.lit(64))).first()[0] or 0) <= BROADCAST_BYTES


def bounded(small: DataFrame, text: str) -> DataFrame:
    """``small``, marked for broadcast if it is small."""
    return F.broadcast(small) if is_small(small, text) else small


def anchors(items: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """``term, item, offset, left, right, whole`` of the rarest term of each window that can occur at all.

    Windows of an item shorter than two of them may all have the same anchor, so it gets its ``EXTRA_ANCHORS`` rarest terms
    as well: a proximity match takes two.  ``left`` and ``right`` are the item's terms beside the anchor, nearest first; ``whole`` is set for an item that is
    one short window.
    """
    vocabulary = cut(items.select(F.explode("terms").alias("term")).distinct())
    words = documents.select(F.explode("terms").alias("term"))
    seen = words.join(bounded(vocabulary, "term"), "term").groupBy("term").agg(F.count("*").alias("seen"))
    length = F.size("terms")
    starts = F.sequence(F.lit(0), F.greatest(length - width, F.lit(0)))
    windows = items.where(length > 0).select("item", "terms", F.explode(starts).alias("start"))
    places = windows.select(
        "item", "terms", "start", F.posexplode(F.slice("terms", F.col("start") + 1, F.lit(width))).alias("step", "term")
    )
    known = places.join(seen, "term", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rarest = known.groupBy("item", "start").agg(
        F.min(F.struct("seen", "term", (F.col("start") + F.col("step")).alias("offset"))).alias("best"), F.first("terms").alias("terms")
    )
    chosen = rarest.where("best.seen > 0").select("item", "terms", "best.term", "best.offset")
    short = known.where(F.size("terms") < 2 * width).select("item", "terms", "seen", "term", (F.col("start") + F.col("step")).alias("offset")).distinct()
    order = Window.partitionBy("item").orderBy("seen", "term", "offset")
    extra = short.where("seen > 0").withColumn("at", F.row_number().over(order)).where(F.col("at") <= EXTRA_ANCHORS)
    chosen = chosen.unionByName(extra.select("item", "terms", "term", "offset")).distinct()
    return chosen.select("term", "item", "offset", *_beside("terms", "offset", width), (F.size("terms") < width).alias("whole"))


def _beside(words: str, at: str, width: int) -> list[Column]:
    """Up to ``width - 1`` terms before a position, nearest first, and after it."""
    here, reach = F.col(at), width - 1
    first = F.greatest(here - reach, F.lit(0))
    return [
        F.reverse(F.slice(words, first + 1, here - first)).alias("left"),
        F.slice(words, here + 2, F.lit(reach)).alias("right"),
    ]


def postings(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The stored index: ``id, digest, term, position, left, right`` of the wanted terms in all documents."""
    if is_small(wanted, "term"):
        placed = documents.select("id", "digest", "terms", F.posexplode("terms").alias("position", "term"))
        return placed.join(F.broadcast(wanted), "term").select("id", "digest", "term", "position", *_beside("terms", "position", width))
    # Postings are shuffled without the documents, which only those with a posting join again.
    placed = documents.select("id", "digest", F.posexplode("terms").alias("position", "term")).join(wanted, "term").alias("p")
    once = documents.dropDuplicates(["id", "digest"]).alias("d")
    same = F.col("p.id").eqNullSafe(F.col("d.id")) & (F.col("p.digest") == F.col("d.digest"))
    return placed.join(once, same).select("p.id", "p.digest", "term", "position", *_beside("terms", "position", width))


def _run(ours: str, theirs: str) -> Column:
    """How many terms agree before the first that does not."""
    same = F.zip_with(ours, theirs, lambda a, b: a.eqNullSafe(b))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def matches(documents: DataFrame, benchmark: DataFrame, width: int, slop: int, item_col: str, item_text_col: str) -> DataFrame:
    """``id, digest, item, first, last`` of each exact run, and rows of null ``first`` for items in proximity."""
    items = benchmark.select(col(item_col).alias("item_id"), terms(col(item_text_col)).alias("terms"))
    items = cut(items.select(F.struct("item_id", F.xxhash64("terms").alias("digest")).alias("item"), "terms").distinct())
    hooks = cut(anchors(items, documents, width))
    index = cut(postings(documents, hooks.select("term").distinct(), width))
    theirs = hooks.select("term", "item", "offset", "whole", F.col("left").alias("item_left"), F.col("right").alias("item_right"))
    met = index.join(theirs, "term").select(
        "id", "digest", "item", "offset", "position", "whole", _run("left", "item_left").alias("before"), _run("right", "item_right").alias("after"),
        F.size("item_left").alias("all_before"), F.size("item_right").alias("all_after"),
    )
    exact = F.when(
        F.col("whole"), (F.col("before") == F.col("all_before")) & (F.col("after") == F.col("all_after"))
    ).otherwise(F.col("before") + F.col("after") + 1 >= width)
    met = met.select(
        "id", "digest", "item", "offset", (F.col("position") - F.col("offset")).alias("aligned"),
        F.when(exact, F.col("position") - F.col("before")).alias("first"), F.when(exact, F.col("position") + F.col("after")).alias("last"),
    )
    beside = Window.partitionBy("id", "digest", "item").orderBy("aligned", "offset")
    near = (F.col("aligned") - F.lag("aligned").over(beside) <= slop) & (F.col("offset") != F.lag("offset").over(beside))
    return met.withColumn("near", F.coalesce(near, F.lit(False))).where("first is not null or near").select("id", "digest", "item", "first", "last")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    slop: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id, digest, n_words, n_hit, items, spans, near_items`` per row of ``docs``.

    ``n_hit`` counts document terms inside occurring windows; ``items`` are the ids of items with such windows, sorted
    as strings; ``spans`` the runs as ``first, last`` term numbers; ``near_items`` the items found in proximity only.
    Null texts have no terms.  Items equal in id and terms count once; a null item id is the empty string.  Repeated
    rows of ``docs`` give equal rows.  No documents give no rows, no items give rows without hits.
    """
    # The texts are cut into terms once; counts, postings and sizes read this table.
    documents = written(identified(docs, id_col, text_col).select("id", "digest", terms(F.col("text")).alias("terms")))
    found = matches(documents, benchmark, width, slop, item_col, item_text_col)
    name = F.coalesce(F.col("item.item_id").cast("string"), F.lit(""))
    hit = found.groupBy("id", "digest").agg(
        F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("spans"),
        F.collect_set(F.when(F.col("first").isNotNull(), F.struct(name.alias("name"), F.col("item.digest").alias("digest")))).alias("held"),
        F.collect_set(name).alias("any"),
    )
    words = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))
    hit = hit.select(
        "id", "digest", F.size(F.array_distinct(words)).cast("bigint").alias("n_hit"),
        F.array_sort(F.transform("held", lambda x: x["name"])).alias("items"), F.array_sort("spans").alias("spans"), "any",
    ).withColumn("near_items", F.array_sort(F.array_except("any", "items"))).drop("any")
    sized = documents.select("id", "digest", F.size("terms").cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    left, right = sized.alias("l"), hit.alias("r")
    on = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.digest") == F.col("r.digest"))
    return left.join(right, on, "left").select(
        "l.id", "l.digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"), F.coalesce("near_items", none).alias("near_items"),
    )
