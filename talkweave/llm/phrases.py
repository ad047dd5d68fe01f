"""Collocations of every language by best-first growth of phrases from their prefixes.

Every cut of a phrase gives ``times * a * n / (l * r)`` and the lowest counts.  As ``r >= a``, no phrase that begins
with a word scores above ``times * n / f(word)``: the count of the first word bounds all that grows from it.  The
frontier holds phrases of at least ``min_count`` occurrences that were not grown yet, in the order of that bound.
Each round takes the best part of every language's frontier, reads the texts once, and counts what these prefixes
grow into; the counts also tell whether a phrase always has the same neighbour, which is when a longer one covers it.
The score of a phrase whose right parts are not all counted yet is bounded the same way, and parts that matter are
counted in the next round.  A language is settled when neither its frontier nor a bound reaches the score of its
``top``-th surviving phrase; ties do reach it.

Phrases are known by 64-bit hashes that hold their language.  Tasks get bitmaps of the wanted hashes, of at most
``MAX_BITS``; a fuller bitmap lets more through to the exact joins, results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm.rows import col, cut, text_batches
from talkweave.llm.words import _FOLDED, _power_tables, flat, mix, slices

MAX_BITS = 1 << 28
PAGE_BITS = 1 << 15
FLUSH = 1 << 20
SHARE = 3

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_BLANK[list(b" \t")] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of all but its last word and of its last word."""
    return mix(prefix * _ODD + word)


def _tokens(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and ``row, start, end, piece`` of every word; words of one piece follow each other."""
    data, offsets = flat(batch.column("text"))
    inside = ~(_BREAK | _BLANK)[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    finals = offsets[1:][offsets[1:] > 0] - 1
    last[finals] = inside[finals]
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    return data, row, start, np.flatnonzero(last) + 1, np.cumsum(_BREAK[data])[start] + row


def _codes(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, row, start, end, piece = _tokens(batch)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLDED[data] * up[: len(data)], out=total[1:])
    langs = batch.column("lang").to_pylist()
    seeds = {lang: xxhash.xxh3_64_intdigest(lang) for lang in set(langs)}
    own = np.fromiter((seeds[x] for x in langs), np.uint64, len(langs))
    return mix(mix((total[end] - total[start]) * down[start]) ^ own[row]), piece, data, row, start, end


def _parts(batches):
    for batch in batches:
        for low, high in slices(batch.column("text")):
            yield batch.slice(low, high - low)


def _words(batches):
    """``id, lang, word, f`` of the words of each few megabytes of text."""
    held: dict[int, list] = {}
    for part in _parts(batches):
        code, _, data, row, start, end = _codes(part)
        lower = data.tobytes().translate(_LOWER)
        ids, first, f = np.unique(code, return_index=True, return_counts=True)
        langs = part.column("lang").to_pylist()
        for i, at, n in zip(ids.view(np.int64).tolist(), first.tolist(), f.tolist(), strict=True):
            if i in held:
                held[i][2] += n
            else:
                held[i] = [langs[row[at]], lower[start[at] : end[at]], n]
        if len(held) > FLUSH // 2:
            yield _word_rows(held)
            held = {}
    if held:
        yield _word_rows(held)


def _word_rows(held):
    lang, word, f = zip(*held.values(), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int64()), pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())],
        ["id", "lang", "word", "f"],
    )


class Bitmap:
    """A set of hashes as one bit each, which may hold others too."""

    def __init__(self, ids: DataFrame):
        n = ids.count()
        self.bits = min(MAX_BITS, max(PAGE_BITS, 1 << (32 * n).bit_length()))
        place = F.pmod("id", F.lit(self.bits))
        pages = ids.groupBy((place / PAGE_BITS).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bitmap"))
        held = bytearray(self.bits // 8)
        for page, bitmap in pages.collect():  # never more than the bitmap's own bytes
            held[page * PAGE_BITS // 8 : (page + 1) * PAGE_BITS // 8] = bitmap
        self.size = n
        self.held = ids.sparkSession.sparkContext.broadcast(bytes(held))

    def reader(self):
        """A test of hashes that tasks can call."""
        held, bits, empty = self.held, self.bits, self.size == 0

        def test(ids: np.ndarray) -> np.ndarray:
            if empty:
                return np.zeros(len(ids), bool)
            at = (ids & np.uint64(bits - 1)).astype(np.int64)
            return (np.frombuffer(held.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        return test


def _grown(frequent, chosen, wanted, max_words: int):
    """``prefix, last, f, before, after`` of the phrases that grow from chosen prefixes or are wanted themselves.

    ``before`` and ``after`` are the neighbour that all occurrences have, 0 where they have none or several.
    """

    def run(batches):
        held, size = [], 0
        for part in _parts(batches):
            code, piece, *_ = _codes(part)
            n = len(code)
            common = frequent(code)
            at = np.flatnonzero(common)
            name = code[at]
            edge = np.concatenate([piece, [-1, -1]])
            for words in range(1, max_words):
                step = np.minimum(at + words, n)
                on = edge[step] == piece[at]
                on[on] = common[step[on]]
                at, prefix = at[on], name[on]
                if not len(at):
                    break
                last = code[at + words]
                name = joined(prefix, last)
                take = chosen(prefix) | wanted(name)
                if take.any():
                    i = at[take]
                    before = np.where((i > 0) & (edge[i - 1] == piece[i]), code[i - 1], np.uint64(0))
                    j = np.minimum(i + words + 1, n)
                    after = np.where(edge[j] == piece[i], code[np.minimum(j, n - 1)], np.uint64(0))
                    held.append((name[take], prefix[take], last[take], before, after))
                    size += len(i)
            if size > FLUSH:
                yield _phrase_rows(held)
                held, size = [], 0
        if held:
            yield _phrase_rows(held)

    return run


def _phrase_rows(held):
    name, prefix, last, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(name)
    name = name[order]
    begins = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    sides = []
    for side in (before, after):
        low, high = np.minimum.reduceat(side[order], begins), np.maximum.reduceat(side[order], begins)
        sides.append(np.where(low == high, low, np.uint64(0)))
    f = np.diff(np.concatenate([begins, [len(name)]]))
    columns = [prefix[order][begins], last[order][begins], f, *sides]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in columns], ["prefix", "last", "f", "before", "after"])


def _named(batches):
    """Adds the hash of a phrase."""
    for batch in batches:
        prefix, last = (batch.column(c).to_numpy().view(np.uint64) for c in ("prefix", "last"))
        yield pa.RecordBatch.from_arrays([pa.array(joined(prefix, last).view(np.int64)), *batch.columns], ["id", *batch.schema.names])


def _tails(batches):
    """Adds the hashes of all proper right parts, the longest first."""
    for batch in batches:
        words = batch.column("words")
        flat_, begins = words.values.to_numpy().view(np.uint64), words.offsets.to_numpy()[:-1]
        length = np.diff(words.offsets.to_numpy())
        found = [None] * len(batch)
        for k in np.unique(length):
            rows = np.flatnonzero(length == k)
            held = flat_[begins[rows][:, None] + np.arange(k)]
            tails = []
            for i in range(1, k):
                name = held[:, i]
                for j in range(i + 1, k):
                    name = joined(name, held[:, j])
                tails.append(name.view(np.int64))
            for row, own in zip(rows, np.stack(tails, axis=1).tolist() if tails else [[]] * len(rows), strict=True):
                found[row] = own
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "tails"])


def _by_lang(df: DataFrame, per_lang: DataFrame, how: str = "left") -> DataFrame:
    """``df`` and a table of one row per language, which is sent to all tasks while it is small, as one language may hold most rows."""
    few = per_lang.limit(100_001).count() <= 100_000
    return df.join(F.broadcast(per_lang) if few else per_lang, "lang", how)


_NODE = "id bigint, lang string, phrase string, words array<bigint>, lefts array<bigint>, f bigint, first bigint, covered boolean, n bigint"


def _score(times: int) -> Column:
    """``value, cut`` of the lowest cut; right parts that are not counted yet stand at their least, the phrase's own count."""
    return F.expr(
        f"""array_min(transform(sequence(1, size(lefts)), k -> named_struct(
            'value', (cast({times} as decimal(38,0)) * f * n) div (cast(lefts[k - 1] as decimal(38,0)) * coalesce(rights[k - 1], f)),
            'cut', k)))"""
    )


def _scored(pool: DataFrame, counts: DataFrame, times: int) -> DataFrame:
    """``pool`` with the counts of right parts, the score or its bound, and ``exact``."""
    parts = pool.select("id", F.posexplode("tails").alias("at", "tail")).join(counts.select(F.col("id").alias("tail"), F.col("f").alias("r")), "tail", "left")
    rights = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("rights"))
    told = pool.join(rights, "id").withColumn("best", _score(times))
    return told.withColumn("exact", ~F.exists("rights", lambda r: r.isNull()))


def collocations(
    docs: DataFrame, min_count: int = 100, top: int = 2000, max_words: int = 5, times: int = 1000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to ``max_words`` words of each language.

    Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` and words are ``[^\\x20\\x09]+``, A-Z in lower case.  A null text is empty,
    a null language ``und``.  A phrase goes when a longer one has as many occurrences.  Ties of a score go to more
    occurrences, then to the smaller phrase; a tie of cuts to the first.  Repeated rows count each, other columns are
    ignored; languages without such phrases, and tables without rows, give no rows.
    """
    rows = text_batches(docs).select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).alias("text"))
    words = rows.mapInArrow(_words, "id bigint, lang string, word string, f bigint").groupBy("id").agg(
        F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("f").alias("f")
    )
    words = cut(words.select("*", F.when(F.col("f") >= min_count, F.col("word")).alias("often")).drop("word"))
    sizes = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut(_by_lang(words.where("often is not null"), sizes, "inner"))
    frequent = Bitmap(words.select("id"))
    none = F.array().cast("array<bigint>")
    frontier = words.select(
        "id", "lang", F.col("often").alias("phrase"), F.array("id").alias("words"), none.alias("lefts"), "f", F.col("f").alias("first"), F.lit(False).alias("covered"), "n"
    )
    counts = words.select("id", "f")
    spark = docs.sparkSession
    pool = spark.createDataFrame([], _NODE + ", tails array<bigint>, rights array<bigint>, best struct<value:bigint,cut:int>, exact boolean")
    bar = spark.createDataFrame([], "lang string, bar bigint")
    while True:
        reach = _by_lang(frontier, bar).where(F.floor(F.col("n") * times / F.col("first")) + 1 >= F.coalesce("bar", F.lit(0))).drop("bar")
        frontier = cut(reach)
        step = F.floor(F.log2("first"))
        mass = frontier.groupBy("lang", step.alias("step")).agg(F.sum("f").alias("mass"), F.first("n").alias("n"))
        so_far = F.coalesce(F.sum("mass").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = mass.withColumn("so_far", so_far).where(F.col("so_far") * SHARE < F.col("n")).groupBy("lang").agg(F.max("step").alias("edge"))
        marked = cut(_by_lang(frontier, cut(edge), "inner").withColumn("now", step <= F.col("edge")).drop("edge"))
        chosen, frontier = marked.where("now").drop("now"), marked.where("not now").drop("now")
        wanted = cut(
            pool.where("not exact").select(F.explode(F.arrays_zip("tails", "rights")).alias("t")).where("t.rights is null").select(F.col("t.tails").alias("id")).distinct()
        )
        takes, wants = Bitmap(chosen.select("id")), Bitmap(wanted)
        if takes.size + wants.size == 0:
            break
        grown = rows.mapInArrow(
            _grown(frequent.reader(), takes.reader(), wants.reader(), max_words), "prefix bigint, last bigint, f bigint, before bigint, after bigint"
        )
        same = lambda side: (F.min(side) == F.max(side)) & (F.min(side) != 0)
        counted = grown.groupBy("prefix", "last").agg(F.sum("f").alias("f"), (same("before") | same("after")).alias("always")).where(F.col("f") >= min_count)
        counted = cut(counted.mapInArrow(_named, "id bigint, prefix bigint, last bigint, f bigint, always boolean"))
        parent = chosen.select(F.col("id").alias("prefix"), "lang", "phrase", "words", "lefts", F.col("f").alias("left"), "first", "n")
        ends = words.select(F.col("id").alias("last"), "often")
        made = counted.join(parent, "prefix").join(ends, "last").select(
            "id", "lang", F.concat_ws(" ", "phrase", "often").alias("phrase"), F.concat("words", F.array("last")).alias("words"),
            F.concat("lefts", F.array("left")).alias("lefts"), "f", "first",
            (F.col("always") & (F.size("words") + 1 < max_words)).alias("covered"), "n",
        )
        made = cut(made.mapInArrow(_tails, _NODE + ", tails array<bigint>"))
        counts = cut(counts.unionByName(counted.select("id", "f")).dropDuplicates(["id"]))
        pool = pool.drop("rights", "best", "exact").unionByName(made.where("not covered"))
        pool = cut(_scored(pool, counts, times))
        order = Window.partitionBy("lang").orderBy(F.desc("best.value"))
        nth = pool.where("exact").withColumn("at", F.row_number().over(order)).where(F.col("at") <= top)
        bar = cut(nth.groupBy("lang").agg(F.count("*").alias("k"), F.min("best.value").alias("bar")).where(F.col("k") == top).select("lang", "bar"))
        pool = cut(_by_lang(pool, bar).where(F.col("best.value") >= F.coalesce("bar", F.lit(0))).drop("bar"))
        frontier = frontier.unionByName(made.where(F.size("words") < max_words).drop("tails"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    at = F.col("best.cut") - 1
    told = pool.select(
        "lang", "phrase", F.col("f").alias("a"), F.get("lefts", at).alias("l"), F.get("rights", at).alias("r"), "n", F.col("best.value").alias("score")
    )
    ranked = told.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
