"""How far the sources of a language differ in their words, from bitmaps of terms by count.

Tasks count the terms of their rows; counts by (language, source, term) meet in one shuffle.  A smoothed share of a
term depends on its count alone, so the terms of a group are stored as one bitset per count.  For two groups the
AND of two bitsets and its population tell how many terms have that pair of counts (a joint cell), which is
multiplied by the difference of the two shares; terms that one or both lack are what the cells leave over.
Bitsets are cut into pages of terms, so a task holds one page of all groups and sums of pages are added.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.rows import col, cut, text_batches

SCALE = 1_000_000_000
SMOOTH = 5
PAGE_TERMS = 256
FLUSH = 400_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_LETTERS).split()


def _counts(batches):
    """``lang, source, term, n, docs``, and one row without a term for every group."""
    found: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = terms(text)
            key = (lang or "", source or "")
            if key not in found:
                found[key] = Counter(), Counter()
            n, docs = found[key]
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > FLUSH:
                yield from _rows(found)
                found, size = {}, 0
    yield from _rows(found)


def _rows(found: dict):
    for (lang, source), (n, docs) in found.items():
        words = [None, *n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
             pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, min_docs: int, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Counts of the terms that a language keeps, and all groups.

    The counts are ``lang, source, term, n, lang_n, first``, where ``first`` marks one row per term of a language.
    """
    rows = text_batches(docs).select(col(lang_col).cast("string").alias("lang"), col(source_col).cast("string").alias("source"), col(text_col).alias("text"))
    parts = rows.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    counted = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    told = counted.withColumns(
        {"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1}
    )
    told = cut(told.where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)))
    return told.where("term is not null").select("lang", "source", "term", "n", "lang_n", "first"), told.where("term is null").select("lang", "source")


def _share(n: Column, base: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / base)``, exact; null where ``base`` is 0."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.when(base > 0, 1 + F.call_function("div", whole(F.lit(SCALE)) * whole(n + SMOOTH), whole(base)))


def _levels(held: pa.Table, names: list[str], at: np.ndarray, width: int):
    """For every group its bitset, share and number of terms by count."""
    place = {name: i for i, name in enumerate(names)}
    group = np.array([place[s] for s in held.column("source").to_pylist()], np.int64)
    n, p = (held.column(c).to_numpy() for c in ("n", "p"))
    for g in range(len(names)):
        own = group == g
        counts, first, level = np.unique(n[own], return_index=True, return_inverse=True)
        bits = np.zeros((len(counts), width), np.uint64)
        np.bitwise_or.at(bits, (level, at[own] >> 6), np.uint64(1) << (at[own] & 63).astype(np.uint64))
        yield bits, p[own][first], np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def page_distances(held: pa.Table, groups: pa.Table) -> pa.Table:
    """``lang, a, b, value``: summed differences of every two groups over the terms of one page."""
    order = np.argsort(groups.column("source").to_numpy(zero_copy_only=False).astype(object), kind="stable")
    names = [groups.column("source")[int(i)].as_py() for i in order]
    zero = groups.column("zero").to_numpy()[order]
    term, at = np.unique(held.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    levels = list(_levels(held, names, at, -(-len(term) // 64)))
    left, right, value = [], [], []
    for a, (bits, p, sizes) in enumerate(levels):
        for b in range(a + 1, len(levels)):
            other, q, others = levels[b]
            cells = np.bitwise_count(bits[:, None, :] & other[None, :, :]).sum(axis=2, dtype=np.int64)
            only_a, only_b = sizes - cells.sum(axis=1), others - cells.sum(axis=0)
            none = len(term) - int(sizes.sum()) - int(only_b.sum())
            total = (cells * np.abs(p[:, None] - q[None, :])).sum() + (only_a * np.abs(p - zero[b])).sum()
            total += (only_b * np.abs(q - zero[a])).sum() + none * abs(int(zero[a]) - int(zero[b]))
            left.append(names[a])
            right.append(names[b])
            value.append(int(total))
    lang = groups.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def source_divergence(
    docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of sources (``pair``) and their own terms (``term``).

    A language keeps the terms that at least ``min_docs`` of its rows have.  A null text, language or source is an
    empty string; a group without terms counts 0 of each, and without kept terms all distances are 0.  Repeated rows
    count each, ties go to the smaller item, other columns are ignored, and no rows give no rows.
    """
    counts, groups = term_counts(docs, min_docs, text_col, lang_col, source_col)
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("bigint")).alias("kept"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    base = F.coalesce("total", F.lit(0)) + SMOOTH * F.coalesce("kept", F.lit(0))
    whole = cut(
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", base.alias("base"), "kept", (F.col("lang_total") + SMOOTH * F.col("kept")).alias("lang_base"), _share(F.lit(0), base).alias("zero")
        )
    )
    told = counts.join(whole, ["lang", "source"]).select(
        "lang", "source", "term", "n", _share(F.col("n"), F.col("base")).alias("p"), _share(F.col("lang_n"), F.col("lang_base")).alias("q"),
        F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / PAGE_TERMS)).alias("page"),
    )
    pages = whole.where("kept > 0").select("lang", "source", "zero", F.explode(F.sequence(F.lit(0), F.ceil(F.col("kept") / PAGE_TERMS) - 1)).alias("page"))
    # New names for the same columns, as both sides come from one table.
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    held = told.select("lang", "page", "source", "term", "n", "p")
    cells = anew(held).groupBy("lang", "page").cogroup(anew(pages).groupBy("lang", "page"))
    sides = cut(cells.applyInArrow(page_distances, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sides.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        sides.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = told.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")),
        own.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top),
    ]
    return ranked[0].unionByName(ranked[1])
