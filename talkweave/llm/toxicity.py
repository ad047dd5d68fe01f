"""Toxicity scores from a learned weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, digits and signs that stand for letters to Latin ones, drops
marks and characters without width and turns everything else into spaces.  The lexicon holds whole words and word beginnings that labelled toxic texts have far
more often than clean ones; its weights are log lifts.  A match inside an exception phrase (two neighbouring words that
clean texts have around a lexicon entry) does not count.  The weights of a text and their rate by length go through a
logistic curve.  Everything is learned from at most ``max_rows`` labelled texts, picked by a hash of their ids.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.rows import col, cut, text_batches

MAX_ROWS = 8000
MAX_ENTRIES = 4000
STEMS = range(4, 9)
MIN_LIFT = 8.0
MIN_SURPRISE = 24.0

# Small letters of other scripts drawn like Latin ones, alone or as capitals, and digits used for letters.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕһԁԛԝ" + "αβεζηικμνορτυχ" + "ıոսօ" + "0123456789",
    "abekmhopctyxijshdqw" + "abezhikmvoptux" + "inuo" + "oizeasgtbg",
)
# Signs used for letters.
SIGNS = {"$": "s", "€": "s", "@": "a", "!": "i", "|": "i"}
_RUN = re.compile(r"[$€@!|]+")


def _letters(run: re.Match) -> str:
    """A run of signs as letters where it stands between letters or digits; ``$`` also after one, or before a letter."""
    signs, text, start, end = run[0], run.string, run.start(), run.end()
    before, after = start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum()
    if before and after:
        return "".join(map(SIGNS.get, signs))
    if before:
        rest = signs.lstrip("$€")
        return SIGNS["$"] * (len(signs) - len(rest)) + rest
    if after and text[end].isalpha():
        rest = signs.rstrip("$€")
        return rest + SIGNS["$"] * (len(signs) - len(rest))
    return signs


class _Fold(dict):
    """Character to folded character, filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Me", "Cf"):
            out = ""
        else:
            bare = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
            low = unicodedata.normalize("NFC", bare).lower().translate(LOOKALIKES)
            out = "".join(c if c.isalpha() else " " for c in low)
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one at each end.

    Compatibility forms become plain letters; accents, other marks and characters without width vanish.
    """
    return " " + " ".join(_RUN.sub(_letters, text or "").translate(_FOLD).split()) + " "


def units(folded: str) -> set[str]:
    """Whole words (spaces around) and word beginnings (a space before)."""
    words = set(folded.split())
    found = {f" {x} " for x in words}
    for size in STEMS:
        found |= {f" {x[:size]}" for x in words if len(x) > size}
    return found


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (entry, weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (f" {phrase} ", None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of each entry that no exception covers."""
        if not len(self.automaton):
            return []
        found, spared = [], []
        for last, (entry, weight) in self.automaton.iter(folded):
            span = (last + 1 - len(entry), last + 1)
            if weight is None:
                spared.append(span)
            else:
                found.append((*span, weight))
        return [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared)]

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of weights, and the sum per hundred words, both on a log scale."""
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def _counted(make):
    """``key, toxic, clean``: rows of each batch that have a key, by label."""

    def run(batches):
        for batch in batches:
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(make(text))
            keys = list(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
                ["key", "toxic", "clean"],
            )

    return run


def _totals(sample: DataFrame, make) -> DataFrame:
    rows = sample.select("text", "toxic").mapInArrow(_counted(make), "key string, toxic bigint, clean bigint")
    return rows.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weights(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    lift = ((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("clean") + 0.5) / (clean + 1.0))
    best = _totals(sample, lambda text: units(fold(text))).withColumn("lift", lift)
    # Log-likelihood ratio of the counts against equal rates: entries of a few rows by chance stay out.
    share = toxic / (toxic + clean)
    both = F.col("toxic") + F.col("clean")
    surprise = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.col("clean") * F.log(F.greatest("clean", F.lit(1)) / (both * (1 - share))))
    best = best.where((F.col("toxic") > 0) & (F.col("lift") >= MIN_LIFT) & (surprise >= MIN_SURPRISE))
    rows = best.orderBy(F.desc(F.col("toxic") * F.log("lift")), "key").limit(MAX_ENTRIES).collect()
    lifts = {r["key"]: r["lift"] for r in rows}
    kept: dict[str, float] = {}
    for entry in sorted(lifts, key=lambda e: (len(e), e)):
        shorter = [entry[:n] for n in range(2, len(entry)) if entry[:n] in kept]
        if not shorter:
            kept[entry] = round(min(6.0, math.log(lifts[entry])), 6)
    return kept


def _phrases(lexicon: Lexicon):
    """Two-word phrases around the entries of a text."""

    def make(text):
        folded = fold(text)
        out = set()
        for start, _, _ in lexicon.hits(folded):
            end = folded.index(" ", start + 1)
            before = folded.rfind(" ", 0, start) if start else -1
            after = folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before + 1 : end])
            if after >= 0:
                out.add(folded[start + 1 : after])
        return out

    return make


def _featured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)] + [batch.column("toxic")], ["total", "rate", "toxic"]
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - ridge * np.r_[beta[:-1], 0]
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge] * x.shape[1] + [1e-6])
        beta = beta + np.linalg.solve(hess, grad)
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS):
    """``(weights, exceptions, beta)`` from labelled rows of one label per id; the smallest label of a repeated id counts."""
    chosen = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    chosen = chosen.groupBy("id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # At most max_rows ids of a few bytes each.
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    sample = cut(texts.join(F.broadcast(cut(chosen)), "id").select("text", "toxic"))
    found = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = found.get(1, 0), found.get(0, 0)
    share = toxic / max(1, toxic + clean)
    flat = np.array([0.0, 0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3))])
    if not toxic or not clean:
        return {}, (), flat
    weights = _weights(sample, toxic, clean)
    around = _totals(sample, _phrases(Lexicon(weights)))
    spared = around.where("clean >= 3 and clean >= 4 * toxic").orderBy(F.desc("clean"), "key").limit(MAX_ENTRIES).collect()
    exceptions = tuple(r["key"] for r in spared)
    rows = sample.mapInArrow(_featured(Lexicon(weights, exceptions)), "total double, rate double, toxic int").collect()
    rows = sorted(tuple(r) for r in rows)
    table = np.array(rows, np.float64)
    return weights, exceptions, _logistic(table[:, :2], table[:, 2])


def scorer(model) -> callable:
    """A function of a text column that gives scores from 0 to 1 under a fitted model."""
    weights, exceptions, beta = model

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        lexicon = _lexicon(weights, exceptions)
        logits = [float(np.dot(beta[:2], lexicon.features(t)) + beta[2]) for t in column.to_pylist()]
        return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in logits], pa.float64())

    return score


_built: dict = {}


def _lexicon(weights, exceptions) -> Lexicon:
    key = (len(weights), hash(frozenset(weights.items())), exceptions)
    if key not in _built:
        _built.clear()
        _built[key] = Lexicon(weights, exceptions)
    return _built[key]


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``.

    ``held_out`` is a boolean of the id column; labels of such ids are not learned from.  Null and empty texts get the
    score of a text without entries.  Without labels of both kinds every score is the learned share of toxic texts.
    """
    model = fit(docs, labels.where(~F.coalesce(held_out, F.lit(False))), id_col, text_col)
    scored = text_batches(docs).select(col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), scorer(model)(col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
