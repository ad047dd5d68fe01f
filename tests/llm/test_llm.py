"""The training-data operators against plain Python on small tables with awkward rows."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.llm import contamination, html, jaccard, lines, mixture, quotes, repetition, rows, secrets, tokens, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns clash with names that the operators use inside.
SCHEMA = "doc_id bigint, text string, source string, id string, digest int, `a.b` int, s string, spans int, label string, dropped_places int"


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y", 3, "z", 4) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def invented(seed, n, vocabulary=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeXYé") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    out += [None, "", " \t\n", "A", "a", out[0], out[0], out[1].upper(), "word " * 3000, " x 　y"]
    return out


AWKWARD_IDS = [7, None, None, 3, 3]


def awkward(spark):
    """Null and repeated ids, repeated rows, a null text."""
    texts = ["one two three four five six", "one two three four five six", None, "b", "b"]
    return table(spark, texts, AWKWARD_IDS, ["p", None, "q", "p", "p"])


def test_word_hashes_follow_the_words():
    texts = [None, "", "Ab ab  c\x0bd", "é f ab", "x" * 50]
    data, offsets = words.flat(pa.array(texts))
    row, hashes = words.hashed(data, offsets, fold=True)
    want = [(i, w.translate(LOWER)) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert row.tolist() == [i for i, _ in want]
    by_hash = defaultdict(set)
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        by_hash[h].add(w)
    assert all(len(s) == 1 for s in by_hash.values()) and len(by_hash) == len({w for _, w in want})


def lines_by_hand(texts, least):
    strip = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    seen = Counter(k for t in texts for k in {strip(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not strip(x) or seen[strip(x)] < least]
        out.append((len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bits", [1 << 16, 1 << 28])
def test_shared_lines(spark, bits):
    rng = random.Random(1)
    pool = ["Menu ", "menu", "\tÉcole", "école", "", "only"] + [f"line {i}" for i in range(40)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(80)] + [None, "", "\n\n", "Menu\nMenu"]
    found, parts = lines.drop_shared_lines(table(spark, texts), min_docs=5, max_bits=bits)
    got = [tuple(r) for r in found.orderBy("doc_id").select(parts["n_lines"], parts["n_dropped"], parts["text"]).collect()]
    assert got == lines_by_hand(texts, 5)
    assert found.columns[:10] == table(spark, texts).columns


def test_shared_lines_keep_the_first(spark):
    found, parts = lines.drop_shared_lines(table(spark, ["b", "a\na\nx", "a", "a\nb"]), min_docs=2, keep="first")
    assert [r[0] for r in found.orderBy("doc_id").select(parts["text"]).collect()] == ["b", "a\nx", "", ""]


def test_filters_merge_like_one(spark):
    many = table(spark, [f"l{i}\nshared{i % 7}" for i in range(60)]).repartition(6)
    held, bits = lines.twice_seen(rows.identified(many, "doc_id", "text"), 1 << 16)
    hashes = lines._hash([f"shared{i}".encode() for i in range(7)])
    assert lines._has(np.frombuffer(held, np.uint8), hashes, bits).all()


def repetition_by_hand(text, least=16):
    w = WORD.findall(text or "")
    longest, short, long, maximal = 0, set(), set(), 0
    best = [max([next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0) for j in range(len(w)) if j != i], default=0) for i in range(len(w))]
    for i, n in enumerate(best):
        if n >= 8:
            longest = max(longest, n)
            short.update(range(i, i + 8))
        if n >= least:
            long.update(range(i, i + n))
            maximal += i == 0 or best[i - 1] != n + 1
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), longest, len(short), len(long), maximal


def test_repetition(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(40)]
    texts = [" ".join(base + base[5:30] + ["z"] + base[:20]), " ".join("ab"[rng.random() < 0.5] for _ in range(120)), "w " * 60, "é # x\né # x\n\n\n<>"]
    texts += [None, "", " ".join(base), " ".join(base[:9] + base[:9])]
    got = table(spark, texts).select("doc_id", repetition.repetition(F.col("text")).alias("r")).orderBy("doc_id").select("r.*").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.longest_repeat, r.n_repeat_words, r.n_covered_words, r.n_maximal) == repetition_by_hand(t), t
        told = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert r.n_dup_lines == len(told) - len(set(told))


def test_repetition_verdicts(spark):
    w = [f"w{i}" for i in range(1000)]
    texts = [" ".join(w), " ".join(w[:19]), " ".join(w + w[:210]), " ".join(w[:60] + w[:60]), " ".join(w + w[:50])]
    got = table(spark, texts).select("doc_id", repetition.repetition(F.col("text")).alias("r")).select("doc_id", repetition.base_failed("r"), repetition.kept("r"))
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == [(False, True), (True, False), (True, False), (True, False), (False, True)]


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        left, free = sum(sizes.values()) - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_mixture(spark, shards):
    rng = random.Random(shards)
    texts = [" ".join(["w"] * rng.randint(0, 200)) + f" {i}" for i in range(900)] + [None, ""]
    sources = [rng.choice(["a", "a", "a", "a", "é", "b", "tiny", None]) if i % 50 else "huge" for i in range(len(texts))]
    docs = table(spark, texts, None, sources)
    plan = mixture.mix(docs, shards=shards, block_words=600)
    got = plan.toPandas()
    assert len(got) == len(texts) and got["size"].tolist() != []
    assert sorted(got["id"]) == list(range(len(texts)))
    by_id = got.set_index("id")
    assert all(by_id.loc[i, "size"] == len(WORD.findall(t or "")) for i, t in enumerate(texts))
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if s != s else s: int(n) for s, n in sizes.items()}
    want = targets_by_hand(sizes)
    for source, size in sizes.items():
        mine = got[got["source"].isna() if source is None else got["source"] == source]
        assert mine["target"].iloc[0] == pytest.approx(want[source])
        assert abs(mine["taken"].sum() - want[source]) <= max(0.01 * want[source], 60)
        assert (mine["source_size"] == size).all()
    assert (got["taken"] == got["shards"].map(len) * got["size"]).all() and got["shards"].map(len).max() <= 3
    assert {s for row in got["shards"] for s in row} <= set(range(shards))
    again = mixture.mix(docs.repartition(7), shards=shards, block_words=600).toPandas()
    a, b = (x.sort_values("id")[["id", "taken", "shards"]].map(str).values.tolist() for x in (got, again))
    assert a == b
    out = mixture.mixed_rows(docs, plan)
    assert out.count() == got["shards"].map(len).sum() and out.columns[: len(docs.columns)] == docs.columns


@pytest.mark.parametrize("long,seed", [(20_000, 1), (20_000, 2), (9_000, 3), (60_000, 4)])
def test_mixture_with_a_text_far_longer_than_a_block(spark, long, seed):
    rng = random.Random(seed)
    texts = ["w " * rng.randint(1, 60) + f"{i}" for i in range(1200)] + ["long " * long] + ["v " * 299 + f"{i}" for i in range(40)] * 2
    sources = ["a"] * 1201 + ["b"] * 80
    ids = list(range(1201)) + [*range(2000, 2040)] * 2
    got = mixture.mix(table(spark, texts, ids, sources), shards=4, seed=seed, block_words=500).toPandas()
    for source, mine in got.groupby("source"):
        once = mine.groupby(["id", "digest"]).agg(size=("size", "sum"), n=("taken", "sum"), size_0=("size", "first"))
        taken, target = int(mine["taken"].sum()), mine["target"].iloc[0]
        whole = int(target // mine["source_size"].iloc[0])
        free = [r.size for r in once.itertuples() if r.size_0 and r.n < (whole + 1) * r.size]
        # The target is missed by less than half the shortest document still free: nothing fits, and one more would not end nearer.
        assert not free or abs(taken - target) <= 0.5 * min(free) + 1, (source, taken, target)
        assert not free or abs(taken - target) <= 300
    assert (got["taken"] == got["shards"].map(len) * got["size"]).all() and got["shards"].map(len).max() <= 3


def test_splitting_tree_deals_every_block_once(spark):
    quotas = {0: 17, 1: 0, 2: 100, 3: 1}
    cells = mixture.splitting_tree(spark.createDataFrame(list(quotas.items()), "number bigint, quota bigint"), 7, 3).collect()
    for number, quota in quotas.items():
        turns = sorted(t for c in cells if c.number == number for t in range(c.start, c.start + c.quota))
        assert turns == list(range(quota))
    per_shard = Counter()
    for c in cells:
        per_shard[c.shard] += c.quota
    assert max(per_shard.values()) - min(per_shard.values()) <= 3


def secrets_by_hand(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 1, m.end(), "assign"))
    out += [(m.start(), 2, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 3, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    for m in re.finditer("[A-Za-z0-9+/=_-]{16,}", text):
        t = m[0]
        both = re.search("[A-Z]", t) and re.search("[0-9]", t)
        if both and re.fullmatch("[A-Z0-9]{16,32}", t):
            out.append((m.start(), 4, m.end(), "id"))
        elif both and len(t) >= 24 and re.search("[a-z]", t):
            out.append((m.start(), 5, m.end(), "key"))
    out += [(m.start(), 6, m.end(), "endpoint") for m in re.finditer(r"https?://[A-Za-z0-9./:_-]+", text)]
    secret = lambda x: secrets.ROLES[x[3]] == "secret"
    out = [x for x in out if x[1] <= 3 or not any(y[1] <= 3 and y[0] <= x[0] and x[2] <= y[2] for y in out)]
    beside = lambda x, y: secret(x) != secret(y) and abs(x[0] - y[0]) <= secrets.REACH and (y[0] >= x[2] or y[2] <= x[0])
    return sorted(x for x in out if x[1] <= 3 or any(beside(x, y) for y in out))


SECRET_TEXTS = [
    "é password = 'abcdefghijkl' tail", "secret: token: abcdefghijklmnop", "API_KEY:'" + "Ab1" * 9 + "'", "x AKIAABCDEFGHIJKLMN y AKIAshort",
    "id QWERTYUIOP123456 near " + "aB3" * 10 + " and https://h.example/x", "QWERTYUIOP123456 " + "w " * 200 + "aB3" * 10,
    "https://lonely.example/path", "deadbeefdeadbeef0 " * 3, "ſecret=abcdefghijklmnop", "token==aaaaaaaaaaaa", None, "", "passwd=" + "z" * 5000,
    "see https://cdn.example.com/Assets/AbCdEf0123456789GhIjKl.png today", "AKIAABCDEFGHIJKLMN1 password=abcdefghijklmnop",
    "https://h.example/x key " + "aB3" * 10, "deadbeefdeadbeef01 " * 9000,
]


def test_secrets(spark):
    docs = table(spark, SECRET_TEXTS)
    got = secrets.find_secrets(docs).orderBy("id").collect()
    assert [[(s.begin, s.rank, s.end, s.kind) for s in r.spans] for r in got] == [secrets_by_hand(t) for t in SECRET_TEXTS]
    assert any(s.kind == "id" for r in got for s in r.spans) and not got[5].spans and not got[6].spans
    by_text = dict(zip(SECRET_TEXTS, got, strict=True))
    assert not by_text[SECRET_TEXTS[13]].spans and [s.kind for s in by_text[SECRET_TEXTS[14]].spans] == ["access", "assign"]
    assert {s.kind for s in by_text[SECRET_TEXTS[15]].spans} == {"endpoint", "key"}
    plan = secrets.find_secrets(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_are_split_and_not_extracted_one_by_one(spark):
    texts = ["", None, "  ", "!a B\x7f0é😀c-", "Éa,,b", "...x", "q\x80r", ":/@[`{ K", "one", "Two  three."]
    found = table(spark, texts).select("doc_id", contamination.terms(F.col("text")).alias("terms"))
    assert "regexp_extract" not in found._jdf.queryExecution().toString()
    assert [r["terms"] for r in found.orderBy("doc_id").collect()] == [TERM.findall((t or "").translate(LOWER)) for t in texts]


def test_texts_that_share_no_key_are_not_shuffled(spark, monkeypatch):
    docs = rows.identified(table(spark, ["a b c d e f", "g h i", None, "j k"]), "doc_id", "text")
    point = F.lit(jaccard._packed_point(jaccard.point_of(np.arange(3, dtype=np.uint64))))
    held = docs.where("id in (1, 3)").select("id", "digest", F.col("id").alias("node"), F.lit(7).cast("bigint").alias("cluster"), F.lit(3).cast("bigint").alias("n"), point.alias("point"))
    members = jaccard._members(docs, held)
    assert "BroadcastHashJoin [digest" in members._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard, "SENT_DIGESTS", 0)
    for found in (members, jaccard._members(docs, held)):
        got = {r["node"]: (r["cluster"], r["n"], sum(r["point"]), len(r["point"]), jaccard._sets_of([bytes(r["body"])], 2)[0].tolist()) for r in found.collect()}
        assert got == {i: (7, 3, 3, jaccard.GROUPS, next(jaccard._sets(pa.array([t]), 2)).tolist()) for i, t in ((1, "g h i"), (3, "j k"))}


def test_runs_of_many_texts_are_those_of_each():
    texts = ["a b c", None, "", "a", "b c a b c a", "c " * 9, "a b c d e"]
    for width in (1, 3, 5):
        for text, got in zip(texts, jaccard._sets(pa.array(texts), width), strict=True):
            hashes = words.hashed(*words.flat(pa.array([text], pa.string())), fold=True)[1]
            assert got.tolist() == words.shingles(hashes, width).tolist()
    data = words.hashed(*words.flat(pa.array(["a b c d"])), fold=True)[1]
    assert len(words.runs(data, 3)) == 2 and len(words.runs(data, 5)) == 0


def test_secrets_match_each_text_once(spark):
    """No pattern is matched again for its groups, its places or a block of them, and the conditions before it miss nothing."""
    plan = spark.range(1).selectExpr("'' as text").select(secrets.candidates(F.col("text")))._jdf.queryExecution().logical().toString()
    assert plan.count("regexp_extract_all(") == len(secrets.PATTERNS)
    texts = [f"{a * n}{d}{b * (m - n)}" for a, d, b in (("A", "1", "B"), ("a", "7", "Z"), ("-", "0", "Q")) for m in (15, 16, 23, 24, 31, 32) for n in (0, 7, 8, 9, m)]
    texts = [f"{t} password=abcdefghijkl" for t in texts] + ["abcdefabcdefabcd", "key AKIA" + "Z" * 14, "token =  'abc.def.ghi.", "token=abcdefghijk", "HTTP://h http://h secret:" + "b" * 12]
    got = secrets.find_secrets(table(spark, texts)).orderBy("id").collect()
    assert [[(s.begin, s.rank, s.end, s.kind) for s in r.spans] for r in got] == [secrets_by_hand(t) for t in texts]


def test_quotes(spark):
    talk = [
        (1, 0, "a", "Shall we  meet?\n\nBring tea."), (1, 1, "b", "Other matter."), (1, 2, "c", "Ann wrote:\n> shall we meet?\nYes."),
        (1, 3, "d", "> Yes.\n>> Shall we meet?\nGood."), (1, 4, "e", "> never said\nHm."), (2, 0, "a", "> Other matter.\nMoved here."),
        (2, 1, "b", None), (None, 1, "b", "> Yes."), (2, None, "b", "x"), (1, 1, "b", "Other matter."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(got) == 9
    assert got[1, 2].path == [0, 2] and got[1, 2].text == "Yes." and got[1, 2].source_turn == 0
    assert got[1, 3].path == [0, 2, 3] and got[1, 3].text == "Good." and got[1, 3].n_quotes == 2
    assert got[1, 4].source_turn is None and got[1, 4].path == [4] and got[1, 4].text == "Hm."
    assert (got[2, 0].source_conv, got[2, 0].source_turn, got[2, 0].path) == (1, 1, [0])
    assert got[2, 1].text == "" and got[None, 1].source_turn is None
    order = sorted((r.path, t) for (c, t), r in got.items() if c == 1)
    assert [t for _, t in order] == [0, 2, 3, 1, 4]


def test_quotes_of_parts(spark):
    first = "Alpha one is a line of more than thirty-two characters.\nalpha two\nalpha three\n\nBeta one\nbeta two\n\nGamma, all that is left to say."
    talk = [
        (1, 0, first),
        (1, 1, "> Alpha one is a line of more than thirty-two characters.\n> alpha two\n> alpha three\n>\n> beta one\n> beta two\nTwo paragraphs."),
        (1, 2, "> alpha two\n> alpha three\nLines of one."),
        (1, 3, "> beta one beta\n> two\n>\n> Gamma, all that\n> is left to say.\nOther breaks."),
        (1, 4, "> alpha two\nInline one\ninline two\n> gamma, all that is left to say.\ninline three\ninline four"),
        (1, 5, "> inline one\n> inline two\nOf the upper piece."),
        (1, 6, "> inline three\n> inline four\nOf the lower piece."),
        (1, 7, "> alpha two\n> beta one\nNot in a row."), (1, 8, "> alpha\nNot a line."), (1, 9, "> Alpha one is a line of more than thirty-two char\nNor this."),
        (2, 0, "> alpha three\n> beta one\nFrom elsewhere."), (2, 1, "é" * 40 + "\nü ß"), (2, 2, "> " + "É" * 40 + "\n> ü ß\nx"),
    ]
    rows = spark.createDataFrame([(c, t, "r", x) for c, t, x in talk], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.source_conv, r.source_turn) for r in quotes.link_quotes(rows).collect()}
    assert [got[1, t] for t in range(1, 7)] == [(1, 0)] * 4 + [(1, 4)] * 2
    assert [got[1, t] for t in (7, 8, 9)] == [(None, None)] * 3
    assert got[2, 0] == (1, 0) and got[2, 2] == (2, 1)


def sets_by_hand(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def components_by_hand(texts, ids, percent, width):
    sets = sets_by_hand(texts, width)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(ids[i], len(sets[i]), ids[find(i)]) for i in range(len(texts))]


def near(seed, families=12, size=14):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 30)}" for _ in range(rng.choice([3, 10, 12, 18, 40, 150, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            out.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 0, 1, 3])]))
    rng.shuffle(out)
    return out + [None, "", "a", "A", "a b", "A  B"]


@pytest.mark.parametrize("percent,width,leaf,seed,hot", [(90, 3, 512, 1, 1 << 16), (80, 5, 3, 2, 1 << 16), (90, 3, 4, 3, 2), (80, 1, 512, 4, 1 << 16), (50, 2, 5, 5, 30)])
def test_near_copies(spark, monkeypatch, percent, width, leaf, seed, hot):
    monkeypatch.setattr(jaccard, "HOT_KEY", hot)
    texts = near(seed)
    got = jaccard.near_copies(table(spark, texts), percent, width, leaf=leaf).orderBy("id").collect()
    assert [(r.id, r.n_shingles, r.component) for r in got] == components_by_hand(texts, list(range(len(texts))), percent, width)


def test_one_of_each_group_stays_whatever_the_ids(spark):
    import corpus_pipeline

    base = [" ".join(f"{k}{i}" for i in range(60)) for k in "xyz"]
    rows = [(None, base[0]), (None, base[0] + " more"), (None, base[0] + " other"), (5, base[1]), (5, base[1] + " more"), (None, base[2]), (9, base[2] + " more")]
    texts, ids = [t for _, t in rows], [i for i, _ in rows]
    docs = table(spark, texts + texts[3:4] * 2, ids + [5, 5], ["s"] * len(rows) + ["a", "t"])
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(r.text[0] for r in kept) == ["x", "y", "z"]
    assert [r.doc_id for r in sorted(kept, key=lambda r: r.text[0])] == [None, 5, 9]
    assert all(r.source == ("a" if r.text == base[1] else "s") for r in kept)


def test_near_copies_of_awkward_rows(spark):
    got = sorted((r.id is None, r.id or 0, r.n_shingles, r.component) for r in jaccard.near_copies(awkward(spark), 90, 3).collect())
    assert got == [(False, 3, 1, 3), (False, 3, 1, 3), (False, 7, 4, 7), (True, 0, 0, None), (True, 0, 4, 7)]


def test_rare_keys_meet_for_every_linked_pair_whatever_the_sketch_says():
    rng = np.random.default_rng(5)
    classes = rng.integers(2, 9, 1 << 16).astype(np.uint8)
    for percent in (50, 80, 90, 99):
        for _ in range(150):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0, 0.02, 0.06, 0.1])]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64)]))
            if len(b) and jaccard.linked(a, b, percent):
                assert set(jaccard.rare_keys(a, classes, percent).tolist()) & set(jaccard.rare_keys(b, classes, percent).tolist())


def test_sketch_never_falls_short(spark):
    texts = [f"a b c d{i % 7} e{i % 3} f" for i in range(300)] + ["once only here", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    classes = np.frombuffer(jaccard.frequency_classes(rows, 3, 1000), np.uint8)
    sets = list(jaccard._sets(pa.array(texts, pa.string()), 3))
    grams, times = np.unique(np.concatenate(sets), return_counts=True)
    assert (classes[jaccard._counters(grams, 16)] >= [int(t).bit_length() for t in times]).all()
    # Rare n-grams come first, and no counter drops a key.
    assert all(len(jaccard.rare_keys(s, classes, 80)) == len(s) - -(-len(s) * 80 // 100) + 1 for s in sets if len(s))


def test_passages_shared_by_many_texts_do_not_gather_them(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{k}x{i}" for i in range(60)) for k in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    classes = np.frombuffer(jaccard.frequency_classes(rows, 5, 1 << 20), np.uint8)
    keys = [jaccard.rare_keys(s, classes, 80) for s in jaccard._sets(pa.array(texts, pa.string()), 5)]
    # The passage is heavy, so keys come from what is a text's own; one counter may hold two n-grams by chance.
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    assert (times > 1).sum() < 60


def test_mates_are_united_only_where_counts_allow_a_link():
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 2**63, 30, dtype=np.uint64)
    apart = [np.unique(np.concatenate([shared, rng.integers(0, 2**63, 300, dtype=np.uint64)])) for _ in range(60)]
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    family = [np.unique(np.concatenate([base[rng.random(300) > 0.03], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(60)]
    for sets in (apart[:20] + family[:3], apart + family):
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in order]
        points, sizes = np.stack([jaccard.point_of(s) for s in sets]), np.array([len(s) for s in sets])
        nodes = np.arange(len(sets))
        pairs = jaccard.allowed_mates(np.full(len(sets), 7), nodes, sizes, points, 80)
        roots = jaccard.Roots()
        for a, b in pairs:
            roots.join(a, b)
        linked = [(i, j) for i in nodes for j in nodes[:i] if jaccard.linked(sets[i], sets[j], 80)]
        assert linked and all(roots.find(i) == roots.find(j) for i, j in linked)
        assert len({roots.find(i) for i in nodes}) > len(sets) // 3


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.sort(base[rng.random(len(base)) > rng.choice([0.01, 0.05, 0.2])]) for _ in range(70)]
    points, sizes = np.array([jaccard.point_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    found = {tuple(sorted(p)) for p in tree.pairs(tree, 90, np.arange(70), np.arange(70))}
    assert {(i, j) for i in range(70) for j in range(i + 1, 70) if jaccard.linked(sets[i], sets[j], 90)} <= found


def test_components(spark):
    rng = random.Random(9)
    node = lambda x: (x * 0x9E3779B97F4A7C15) % 2**63
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = rows.components(spark.createDataFrame([(node(a), node(b)) for a, b in pairs], "a bigint, b bigint")).collect()
    label = {r.node: r.component for r in got}
    assert len({label[node(i)] for i in range(41)}) == 1 and len({label[node(i)] for i in range(100, 130)}) == 1
    assert all(label[node(a)] == label[node(b)] for a, b in pairs if a != b) and label[node(0)] != label[node(100)]


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lan", "mir", "tos", "ned")]
    rude, texts, labels = ["scumbag", "morone"], [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if toxic := i % 6 == 0:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["scumbag", "Mor0ne", "mоrone", "SCUMBAG!"])
        texts.append(" ".join(w))
        labels.append(int(toxic))
    docs = table(spark, texts + [None, "", "scumbag " * 2000])
    lab = spark.createDataFrame([(i, t) for i, t in enumerate(labels)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, lab, F.col("doc_id") % 4 == 2).orderBy("id").collect()
    held = [(r.predicted, labels[r.id]) for r in got if r.held_out and r.id < 900]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(held) > 200
    assert got[900].score == got[901].score < 0.3 and got[902].score > 0.9
    assert all(0 <= r.score <= 1 for r in got) and rude
    none = toxicity.toxicity(docs, lab.limit(0), F.lit(False)).select("score").distinct().collect()
    assert len(none) == 1


def test_lexicon_exceptions_spare_their_phrase():
    lexicon = toxicity.Lexicon({" trash ": 2.0}, ("trash can",))
    assert lexicon.hits(toxicity.fold("The TR4SH can")) == [] and len(lexicon.hits(toxicity.fold("you trash"))) == 1


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    pool = ["hello", " world", "  ", "\n\n", "\t", "'ll", "don't", "é", "日本", "😀", "<|endoftext|>", "<|endof", "ßß", "123", "!?", " ", " ", "\u0085", "\x1f", "á", "\U0001fbf0", "࢏"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(400)] + [None, "", " ", "x" * 20000, "<|endoftext|>"]
    got = table(spark, texts).select("doc_id", tokens.token_count(spark, F.col("text"), path).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in got] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_by_hand(texts, items, width=10):
    bench = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in items]
    out = []
    for t in texts:
        w, hit, held = TERM.findall((t or "").translate(LOWER)), set(), set()
        for item, terms in bench:
            n = min(width, len(terms))
            windows = {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    held.add(str(item))
        out.append((len(w), len(hit), sorted(held)))
    return out


def test_contamination(spark, monkeypatch):
    rng = random.Random(2)
    vocab = ["the", "of", "a", "é1", "kappa", "zeta", "to", "in"] + [f"r{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "the the the the the the the the the the the the")]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        part = items[rng.randrange(25)][1].upper().split()
        texts.append(", ".join(w[:20] + part[: rng.choice([5, 10, 12, 40])] + w[20:]))
    texts += [None, "", "THE " * 40, "no-such_thing"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = contamination_by_hand(texts, items)
    for limit in (contamination.BROADCAST_BYTES, 0):
        monkeypatch.setattr(contamination, "BROADCAST_BYTES", limit)
        got = contamination.contamination(table(spark, texts), bench).orderBy("id").collect()
        assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == want
    assert sum(n > 0 for _, n, _ in want) > 10
    empty = contamination.contamination(table(spark, texts), bench.limit(0))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(texts)


def test_contamination_proximity(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    words_ = item.split()
    texts = [item, " ".join(words_[:9] + ["x"] + words_[9:18] + ["y"] + words_[18:]), "nothing alike"]
    got = contamination.contamination(table(spark, texts), bench).orderBy("id").collect()
    assert [(r.n_hit, list(r["items"]), list(r.near_items)) for r in got] == [(20, ["i"], []), (0, [], ["i"]), (0, [], [])]


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page"><nav><ul><li><a href="/a">Home</a>'
    '<li><a href="/b">More {n}</a></ul></nav><header>Site {n}</header><div class="cookie-notice">We use cookies</div><article><h1>Head {n}</h1>'
    '<p>First &amp; long paragraph with words, words and <b>bold <i>text</i>. It goes on\n and on, number {n}.<br>New line.<p>Second paragraph &lt;here&gt;, of some length too.'
    '<div class="ad">Buy {n} now</div></article><aside>Side</aside><section class="comments"><p>Nice post, thanks a lot!</p></section><form>Name <input></form>'
    "<footer>&copy; 2024 all rights</footer></body></html>"
)


def test_main_text(spark):
    pages = [(i, PAGE.replace("{n}", str(i)), "u") for i in range(40)] + [(40, None, "u"), (41, "", "u"), (42, "<p>", "u"), (43, "</div></p><b", "u"), (None, PAGE, "u")]
    df = spark.createDataFrame(pages, "page_id bigint, html string, text string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    for i in range(40):
        assert got[i] == f"Head {i}\nFirst & long paragraph with words, words and bold text. It goes on and on, number {i}. New line.\nSecond paragraph <here>, of some length too."
    assert got[40] == "" and got[41] == "" and got[42] == ""
    assert html.main_text(df.limit(0)).count() == 0


def test_decoding_is_the_best_of_all_consistent_choices():
    rng = np.random.default_rng(1)
    states = {"content": 1, "boilerplate": -1, "mixed": 0}
    for _ in range(60):
        size = int(rng.integers(1, 7))
        nodes = [html.Node("div", frozenset(), None)]
        for _ in range(size - 1):
            nodes.append(html.Node("div", frozenset(), nodes[-1] if rng.random() < 0.5 else nodes[0]))
        for node in nodes:
            node.text = int(rng.integers(0, 200))
        odds = rng.normal(0, 1, size)
        own = [n.text**0.5 * o / 3 for n, o in zip(nodes, odds, strict=True)]
        best, of_choice = -1e9, {}
        for labels in itertools.product(states, repeat=size):
            named = dict(zip(map(id, nodes), labels, strict=True))
            if any(n.parent and named[id(n.parent)] not in ("mixed", named[id(n)]) or named[id(n)] == "mixed" and not n.children for n in nodes):
                continue
            score = sum(abs(s) - 0.5 if x == "mixed" else states[x] * s for s, x in zip(own, labels, strict=True))
            choice = tuple(s > 0 if x == "mixed" else x == "content" for s, x in zip(own, labels, strict=True))
            best, of_choice[choice] = max(best, score), max(score, of_choice.get(choice, -1e9))
        html.decode(nodes, odds)
        assert abs(of_choice[tuple(n.choice for n in nodes)] - best) < 1e-9


def test_tags_end_where_they_end():
    def text(page):
        nodes = html.parse(page)
        for node in nodes:
            node.choice = True
        return html.blocks(nodes)

    assert text('<p>x<img alt="a"b">y') == ["xy"]
    assert text("<p>x<a title='1 > 0' href=q>y</a> z") == ["xy z"]
    assert text('<p>it <a href="/a>is</a> here</p>') == ["it is here"]
    assert text("<p>a<!-->b<!-- c --!>d</!e>f<!-- g") == ["abdf"]
    assert text("<p>1 < 2 <b>and</b> 3 > 2<a href=") == ["1 < 2 and 3 > 2"]
    assert text("<ul><li>a<b>b<li>c</ul><table><tr><td>d</b>e<td>f</table>g") == ["ab", "c", "de", "f", "g"]


@pytest.mark.parametrize("part", ["<a ", "<b><li>x", "<b></i>", '<a b="', "<!", "<p><div></p>", "<td></b>", "<body>", "</", "<a b='c\" "])
def test_broken_pages_take_linear_time(part):
    def steps(page):
        start = time.process_time()
        nodes = html.parse(page)
        html.decode(nodes, np.zeros(len(html.features(nodes))))
        html.blocks(nodes)
        return time.process_time() - start

    pieces = re.findall("<[^<]*", part)
    assert steps("".join(p * 40_000 for p in pieces)) < 12 and steps(part * 40_000) < 12


def test_main_text_without_telling_markup(spark):
    """The trees do not need the markup that their labels come from."""
    bare = re.sub(r"<(/?)(article|section|nav|header|aside|form|footer)[^>]*>", r"<\1div>", re.sub(r"<div [^>]*>", "<div>", PAGE))
    pages = spark.createDataFrame([(i, PAGE.replace("{n}", str(i))) for i in range(30)], "page_id bigint, html string")
    model = html.fit(pages)
    found = spark.createDataFrame([(1, bare.replace("{n}", "7"))], "page_id bigint, html string")
    got = html.main_text(found, model).first()["text"]
    assert "First & long paragraph with words" in got and "Second paragraph" in got and "Home" not in got


def test_fit_is_the_same_whatever_the_partitions(spark):
    rows = [(i % 25, PAGE.replace("{n}", str(i))) for i in range(50)] + [(None, "<p>x"), (None, None), (3, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    models = [html.fit(pages.repartition(n), max_pages=20, max_nodes=900) for n in (1, 7)]
    for one, other in zip(models[0].trees, models[1].trees, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(one, other, strict=True))


@pytest.mark.parametrize(
    "written",
    ["moron", "MORON", "m0r0n", "ｍｏｒｏｎ", "móron", "mo\u0301ron", "mo\u200bron", "mo\u00adron", "мorоn", "ΜΟron", "𝐦𝐨𝐫𝐨𝐧"],
)
def test_fold_of_disguised_letters(written):
    assert toxicity.fold(written) == " moron "


@pytest.mark.parametrize(
    "written, plain",
    [("Tr@$h!", "trash"), ("a$$", "ass"), ("$hit sh!t", "shit shit"), ("b1tch 8itch", "bitch bitch"), ("НЕК", "hek"), ("idiot! @you", "idiot you"), ("$ ! @", ""), (None, "")],
)
def test_fold_of_signs(written, plain):
    assert toxicity.fold(written).strip() == plain


def test_awkward_rows_do_not_break_any_operator(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "two three")], "item_id int, text string")
    found, parts = lines.drop_shared_lines(docs, min_docs=2)
    assert sorted(r[0] for r in found.select(parts["n_dropped"]).collect()) == [0, 1, 1, 1, 1]
    assert mixture.mix(docs).count() == 5 and secrets.find_secrets(docs).count() == 5
    got = contamination.contamination(docs, bench).collect()
    assert len(got) == 5 and sum(r.n_hit for r in got) == 4
    empty = docs.limit(0)
    assert lines.drop_shared_lines(empty)[0].count() == 0 and mixture.mix(empty).count() == 0
    assert secrets.find_secrets(empty).count() == 0 and jaccard.near_copies(empty).count() == 0
    assert contamination.contamination(empty, bench).count() == 0


def pipeline_by_hand(docs, items):
    """``(doc_id, text)`` that are left before mixing."""
    kept = [(i, t) for i, t in docs if (r := repetition_by_hand(t))[0] >= 20 and 100 * r[4] <= 30 * r[0] and 100 * r[5] <= 20 * r[0] and r[3] <= 200]
    kept = [(i, x[2]) for (i, _), x in zip(kept, lines_by_hand([t for _, t in kept], 10), strict=True)]
    groups = components_by_hand([t for _, t in kept], [i for i, _ in kept], 80, 5)
    kept = [x for x, (i, _, c) in zip(kept, groups, strict=True) if i == c]
    hits = contamination_by_hand([t for _, t in kept], items)
    return [x for x, h in zip(kept, hits, strict=True) if not h[1]]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(4)]
    texts = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([10, 40, 90]))]
        if i % 9 == 0:
            w += items[i % 4][1].split()
        if i % 8 == 1:
            w += w[:30] * 2
        texts.append(" ".join(w) + ("\nsame footer line" if i % 3 == 0 else ""))
    texts += [texts[3], texts[3] + " extra", None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = rows.cut(stage(spark, left, str(tmp_path)))
        assert left.columns == docs.columns
    want = pipeline_by_hand(list(enumerate(texts)), items)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(want) and 5 < len(want) < 50
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) <= {i for i, _ in want}
    total = sum(len(WORD.findall(t)) for _, t in want)
    assert abs(out["text"].map(lambda t: len(WORD.findall(t))).sum() - total) <= 0.15 * total


