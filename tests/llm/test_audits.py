"""Phrases, source distances and exact copies against plain Python on small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.llm import copies, divergence, phrases, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns clash with names that the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, kept int, term string, page int, `a.b` int, row string, f int, n int"


def table(spark, data):
    return spark.createDataFrame([(i, t, lang, source, "x", 1, "t", 2, 3, "r", 4, 5) for i, t, lang, source in data], SCHEMA)


def copies_by_hand(data):
    group = defaultdict(list)
    for at, (i, text, *_) in enumerate(data):
        text = text or ""
        group[re.sub(r"[\x20\x09-\x0D]+", "", text)].append((-len(text), i is None, i if i is not None else 0, at))
    out = []
    for key, members in group.items():
        best = min(members)
        out += [(data[m[3]][0], data[best[3]][0], len(members), hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


COPIED = [
    (5, "a b c", "en", "s"), (4, "ab c", "en", "s"), (9, "a  b c\n", "en", None), (9, "a  b c\n", "en", None), (None, "a  b c\t", None, "s"),
    (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n\v\f\r", "en", "s"), (7, " ", "en", "s"), (8, "A b c", "en", "s"),
    (10, "long " * 200_000, "en", "s"), (11, "long" * 200_000, "en", "s"), (12, "é", "en", "s"), (13, "é", "en", "s"), (None, None, None, None),
]


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 28])
def test_exact_copies(spark, max_bits):
    rng = random.Random(3)
    data = COPIED + [(100 + i, rng.choice(["x y", "xy ", "y"]) * rng.randint(1, 3) + str(rng.randint(0, 40)), "en", "s") for i in range(300)]
    found = copies.exact_copies(table(spark, data), max_bits=max_bits).collect()
    got = sorted([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=repr)
    assert got == copies_by_hand(data)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in found})


def test_a_saturated_filter_only_suspects_more(spark):
    data = [(i, f"text {i // 2 if i < 40 else i}", "en", "s") for i in range(60_000)]
    found = copies.exact_copies(table(spark, data), max_bits=1 << 15)
    assert found.where("group_size = 2").count() == 40 and found.where("kept").count() == 60_000 - 20


def test_filter_suspects_few_without_cause(spark):
    digests = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"))
    marked = copies.suspected(digests.unionByName(digests.limit(50)), 1 << 19)
    assert 100 <= marked.where("suspect").count() < 1200


def test_large_groups_join_where_they_are(spark):
    held = spark.range(30_000).select(F.when(F.col("id") < 20_000, "big").otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = held.groupBy("k").count()
    joined = rows.by_size(held, groups, "k", "count", 30_000)
    assert joined.count() == 30_000 and joined.where("count = 20000").count() == 20_000


def test_rows_that_stay_keep_all_columns(spark):
    docs = table(spark, COPIED)
    kept = copies.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, *_ in COPIED})
    assert copies.exact_copies(docs.limit(0)).count() == 0


def test_exact_copies_stay_in_the_jvm(spark):
    plan = copies.exact_copies(table(spark, COPIED))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def divergence_by_hand(data, least, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, count, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in data:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [w.translate(LOWER) for w in word.findall(text or "")]
        docs.update((lang, w) for w in set(found))
        count[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = {w for (la, w), n in docs.items() if la == lang and n >= least}
        mates = [s for la, s in groups if la == lang]
        n = {s: sum(count[lang, s][w] for w in kept) for s in mates}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: {w: share(count[lang, s][w], n[s]) for w in kept} for s in mates}
        whole = {w: share(sum(count[lang, s][w] for s in mates), sum(n.values())) for w in kept}
        pairs = [(-sum(abs(p[source][w] - p[s][w]) for w in kept), s) for s in mates if s != source]
        own = [(whole[w] - p[source][w], w) for w in kept if count[lang, source][w] and p[source][w] > whole[w]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def told(seed, n, langs=("en", "fr", None), sources=("a", "b", "c", None, "é")):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcXYéß") for _ in range(rng.randint(1, 3))) for _ in range(90)]
    line = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", ", ", "\n", "7", "\t", ". "]) for _ in range(rng.randint(0, 60)))
    return [(i, line(), rng.choice(langs), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("least,page", [(1, 8), (30, 64), (10**6, 256)])
def test_source_divergence(spark, monkeypatch, least, page):
    monkeypatch.setattr(divergence, "PAGE_TERMS", page)
    data = told(least, 250) + [(1, None, "en", "void"), (2, "", "de", "only"), (3, "12 34", "en", "void"), (1, None, None, None), (4, "word " * 30_000, "en", "a")]
    found = divergence.source_divergence(table(spark, data), min_docs=least, top=7)
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found.collect()) == divergence_by_hand(data, least, 7)


def test_source_divergence_without_rows(spark):
    assert divergence.source_divergence(table(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


def test_joint_cells_make_up_every_term():
    rng = random.Random(1)
    held = [("s%d" % s, "t%03d" % t, n, 10 + n) for s in range(3) for t in range(200) if (n := rng.choice([0, 0, 1, 2, 9]))]
    cells = pa.table({c: [x[i] for x in held] for i, c in enumerate(("source", "term", "n", "p"))})
    groups = pa.table({"lang": ["en"] * 4, "source": ["s0", "s1", "s2", "none"], "zero": [10, 10, 10, 3]})
    got = {(r["a"], r["b"]): r["value"] for r in divergence.page_distances(cells, groups).to_pylist()}
    p = defaultdict(lambda: 10) | {(s, t): v for s, t, _, v in held}
    terms = {t for _, t, *_ in held}
    for (a, b), value in got.items():
        share = lambda s, t: 3 if s == "none" else p.get((s, t), 10)
        assert value == sum(abs(share(a, t) - share(b, t)) for t in terms)
    assert len(got) == 6


def phrases_by_hand(data, least, top, longest, times):
    f, n = Counter(), Counter()
    for _, text, lang, _ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in cand.items():
        covered |= {(lang, w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= f[lang, w[i : i + k]]}
    ranked = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) in covered:
            continue
        score, cut = min((times * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        ranked[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return sorted(
        (lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, found in ranked.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)
    )


def prose(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abXé7") for _ in range(rng.randint(1, 3))) for _ in range(25)]
    fixed = [" ".join(rng.choice(vocab) for _ in range(k)) for k in (2, 3, 4, 5, 6, 7)]
    pick = lambda: rng.choice(fixed) if rng.random() < 0.25 else vocab[min(int(rng.expovariate(0.25)), 24)]
    line = lambda: "".join(pick() + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", "\x0b"]) for _ in range(rng.randint(0, 80)))
    return [(i, line(), rng.choice(["en", "en", "fr", None]), "s") for i in range(n)]


@pytest.mark.parametrize("seed,least,top,longest", [(1, 5, 10_000, 5), (2, 5, 12, 5), (4, 20, 3, 3)])
def test_collocations(spark, seed, least, top, longest):
    data = prose(seed, 150) + [(1, None, "en", "s"), (2, "", "de", "s"), (3, "a a a a a a a a a", "fr", "s"), (4, "a b " * 30_000, "xx", "s")]
    data += data[:2]
    found = phrases.collocations(table(spark, data), min_count=least, top=top, max_words=longest)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())
    assert got == phrases_by_hand(data, least, top, longest, 1000)


def test_collocations_settle_without_growing_everything(spark, monkeypatch):
    """Frequent first words are never grown where the bar lies above their bound, and the result is still whole."""
    rng = random.Random(9)
    rare = [f"r{i} q{i}" for i in range(30)]
    data = [(i, " ".join(rng.choice(rare) if rng.random() < 0.3 else rng.choice("abcde") for _ in range(200)), "en", "s") for i in range(60)]
    grown = []
    bitmap = phrases.Bitmap

    class Watched(bitmap):
        def __init__(self, ids):
            super().__init__(ids)
            grown.append(self.size)

    monkeypatch.setattr(phrases, "Bitmap", Watched)
    found = phrases.collocations(table(spark, data), min_count=10, top=20).collect()
    want = phrases_by_hand(data, 10, 20, 5, 1000)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found) == want
    frequent = Counter(tuple(t.split()[i : i + k]) for _, t, *_ in data for k in range(1, 5) for i in range(len(t.split()) - k + 1))
    assert want and sum(grown[1::2]) * 2 < sum(f >= 10 for f in frequent.values())


def test_collocations_without_rows(spark):
    assert phrases.collocations(table(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    big = 3_000_000_019
    pool = spark.createDataFrame([(1, [big, 7 * big], [11 * big, None], 5 * big, 90 * big)], "id int, lefts array<bigint>, rights array<bigint>, f bigint, n bigint")
    best = pool.select(phrases._score(1000).alias("b")).first()["b"]
    cuts = [(1000 * 5 * big * 90 * big // (big * 11 * big), 1), (1000 * 5 * big * 90 * big // (7 * big * 5 * big), 2)]
    assert (best["value"], best["cut"]) == min(cuts)
    share = spark.createDataFrame([(9_000_000_000_000, 9_500_000_000_011)], "n bigint, base bigint").select(divergence._share(F.col("n"), F.col("base"))).first()[0]
    assert share == 1 + 10**9 * 9_000_000_000_005 // 9_500_000_000_011
