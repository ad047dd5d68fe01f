import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from talkweave.operators import embed, fusion, search

WORDS = "beach sunny hike hills rain coffee tea मीटिंग naïve".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "cold"]), i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    rows += [("hot", 1000 + i, "beach beach sunny") for i in range(100)]  # copies tie on purpose
    return rows, spark.createDataFrame(rows, "workspace_id string, message_id bigint, text string").repartition(7)


QUERIES = [("q1", "hot", "beach SUNNY beach"), ("q2", "cold", "tea"), ("q3", "hot", "zzz"), ("q4", "hot", ""), ("q5", "hot", "naïve मीटिंग rain")]


def brute_bm25(rows, ws, query, k):
    mine = [(i, re.findall(r"\w+", t.lower())) for w, i, t in rows if w == ws]
    avg = sum(len(t) for _, t in mine) / len(mine)
    scores = []
    for i, toks in mine:
        s = 0.0
        for term in set(re.findall(r"\w+", query.lower())):
            df = sum(term in t for _, t in mine)
            tf = toks.count(term)
            if tf:
                idf = math.log((len(mine) - df + 0.5) / (df + 0.5) + 1)
                s += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avg))
        if s > 0:
            scores.append((round(s, 9), i))
    return sorted(scores, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("path", ["packed", "joined", "too large"])
def test_bm25(spark, docs, path, monkeypatch):
    rows, df = docs
    q = spark.createDataFrame(QUERIES, "query_id string, workspace_id string, text string")
    if path == "too large":
        monkeypatch.setattr(search, "PACKED_NUMBERS", 3)
    if path != "joined":
        found = search.bm25_topk(df, q, 7)
    else:
        found = search.bm25_join(search.tokenised(df), search.query_terms(q), 7)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.message_id))
    for qid, ws, text in QUERIES:
        want = brute_bm25(rows, ws, text, 7)
        mine = got.get(qid, [])
        assert [i for _, i in mine] == [i for _, i in want]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=1e-8)


def test_postings_count_short_and_long_texts(spark):
    df = spark.createDataFrame([("w", 1, "a b a"), ("w", 2, " ".join(["x"] * 90 + ["y"] * 10))], "workspace_id string, message_id int, text string")
    got = {(r.message_id, r.term): (r.tf, r.dl) for r in search.postings(search.tokenised(df)).collect()}
    assert got == {(1, "a"): (2, 3), (1, "b"): (1, 3), (2, "x"): (90, 100), (2, "y"): (10, 100)}


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((400, 6)).astype(np.float32)
    data[200:] = data[7]  # half of the table is copies of one vector
    data[3] = 0
    rows = [(["w", "v"][i % 2], f"m{i:03d}", f"p{i % 3}", data[i].tolist()) for i in range(400)]
    asked = [(f"q{i}", "w", f"p{i % 3}", rng.standard_normal(6).astype(np.float32).tolist()) for i in range(5)] + [("same", "w", "p1", data[7].tolist())]
    v = spark.createDataFrame(rows, "workspace_id string, message_id string, person_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(asked, "query_id string, workspace_id string, person_id string, embedding array<float>")
    return rows, asked, v, q


def brute_cosine(rows, asked, k, person):
    out = {}
    for qid, ws, p, vec in asked:
        a = np.array(vec, dtype=np.float64)
        scores = []
        for w, m, pp, e in rows:
            if w != ws or (person and pp != p):
                continue
            b = np.array(e, dtype=np.float64)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scores.append((round(float(a @ b / norm), 9) if norm else 0.0, m))
        out[qid] = [m for _, m in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return out


@pytest.mark.parametrize("person", [False, True])
@pytest.mark.parametrize("path", ["packed", "cells"])
def test_cosine(vecs, person, path, monkeypatch):
    rows, asked, v, q = vecs
    if path == "cells":
        monkeypatch.setattr(search, "PACKED_REQUESTS", 1)
        monkeypatch.setattr(search, "CELL_REQUESTS", 2)
        monkeypatch.setattr(search, "CELL_VALUES", 30 * 6)
    scope = ["workspace_id", "person_id"] if person else ["workspace_id"]
    got = {}
    for r in search.cosine_topk(v, q, 9, scope).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.message_id)
    assert got == brute_cosine(rows, asked, 9, person)


def test_packed_cosine_works_on_bounded_runs(vecs, monkeypatch):
    """The matrices held at once do not follow the batch, every row is scored once, and the hits stay the same."""
    rows, asked, v, q = vecs
    monkeypatch.setattr(search, "VECTOR_NUMBERS", 60)
    assert [r.message_id for r in search.cosine_topk(v, q, 9).filter("query_id = 'q1'").orderBy("rank").collect()] == brute_cosine(rows, asked, 9, False)["q1"]
    caught = []
    monkeypatch.setattr(search, "local_topk", lambda table, score, *_: caught.extend([table, score]))
    search.cosine_topk(v, q, 9)
    batch = caught[0].toArrow().combine_chunks().to_batches()[0]
    runs = [(scores.shape, here) for scores, here, _ in caught[1](batch)]
    assert max(n * m for (n, m), _ in runs) <= 60 and len(runs) > 1
    assert sorted(i for _, here in runs for i in here) == [i for i, w in enumerate(batch["_scope"].to_pylist()) if "w" in w.split('"workspace_id":')[1]]


def test_ann_finds_most_and_scores_exactly(spark, vecs):
    rows, asked, v, q = vecs
    one = v.filter("workspace_id = 'w'")
    exact = search.cosine_topk(one, q, 5)
    near = search.ann_topk(one, q, 5, dims=6, bits=4, probes=11)
    assert search.recall(near, exact).first().recall >= 0.8
    full = search.ann_topk(one, q, 5, dims=6, bits=4, probes=16)
    assert search.recall(full, exact).first().recall == 1.0


def hits(spark, rows, schema="query_id string, message_id string, score double"):
    return spark.createDataFrame(rows, schema)


def test_hybrid_merge_keeps_larger_score_and_limit(spark):
    a = hits(spark, [("q", "1", 0.5), ("q", "2", 0.9)])
    b = hits(spark, [("q", "1", 7.0), ("q", "3", 0.1)])
    got = [(r.message_id, r.score) for r in fusion.hybrid_merge(a, b, 2).orderBy("rank").collect()]
    assert got == [("1", 7.0), ("2", 0.9)]


def test_weak_pass(spark):
    q = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c"), ("r3", "d")], "request_id string, query_id string")
    h = hits(spark, [("a", "1", 0.4), ("a", "2", 0.3), ("c", "1", 0.33), ("c", "2", 0.2), ("d", "1", 0.5), ("d", "2", 0.25)])
    assert {r.request_id: r.is_weak for r in fusion.weak_pass(h, q).collect()} == {"r1": True, "r2": True, "r3": False}


def test_boost_counts_keyword_hits_for_every_phrasing(spark):
    q = spark.createDataFrame([("r", "a"), ("r", "b")], "request_id string, query_id string")
    sem = spark.createDataFrame([("r", "a", "1", 0.5), ("r", "b", "2", 0.4)], "request_id string, query_id string, message_id string, score double")
    kw = spark.createDataFrame([("r", "2", 2.0)], "request_id string, message_id string, score double")
    got = {r.message_id: (r.found_by, round(r.score, 6)) for r in fusion.multi_query_boost(sem, kw, q).collect()}
    assert got == {"1": (1, 0.5), "2": (2, 2.3)}


def test_rerank_verdict_and_citations(spark):
    c = spark.createDataFrame([("r", 1, "a", 0.2), ("r", 2, "b", 0.5), ("r", 3, "c", 0.9), ("n", 1, "x", 0.1)], "request_id string, ordinal bigint, message_id string, score double")
    s = spark.createDataFrame([("r", 1, 0.95), ("r", 3, 0.1)], "request_id string, ordinal bigint, score double")
    q = spark.createDataFrame([("r", "1"), ("r", "2"), ("n", "3")], "request_id string, query_id string")
    g = fusion.passing(fusion.apply_rerank(c, s), q)
    assert [(r.message_id, r.passes) for r in g.filter("request_id = 'r'").orderBy("rank").collect()] == [("a", True), ("b", True), ("c", False)]
    v = {r.request_id: r for r in fusion.verdicts(g).collect()}
    assert v["r"].status == "answered" and v["r"].near_misses is None
    assert v["n"].status == "not_found" and v["n"].near_misses == ["x"]
    cited = fusion.citations(g, fusion.verdicts(g)).collect()
    assert len(cited) == 1 and [x.message_id for x in cited[0].citations] == ["a", "b"]


def test_model_slot_and_hashing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "a b")], "message_id int, text string")

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = {r.message_id: r.embedding for r in embed.embed_with_model(df, load).collect()}
    assert got[1] == [len("passage: a b"), 1.0]
    hashed = {r.message_id: r.embedding for r in embed.hash_embed(df, dims=16).collect()}
    assert hashed[1] == hashed[3] and sum(x * x for x in hashed[1]) == pytest.approx(1)
    assert sum(hashed[2]) == 0


def test_verdict_also_finds_near_misses(spark):
    """Requests whose best hits are unjudged and below the grade of keyword scores are not answered by them."""
    rows = contract.queries()["qa_verdict"](spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in rows} == {"answered"}
    assert {r.request_id: r.keyword_near_misses for r in rows if r.keyword_status == "not_found"} == {
        2: "706,970,371", 3: "979,338,936", 4: "71,240,690", 5: "378,789,160", 7: "195,800,825", 9: "658,181,99",
    }


def test_packed_search_works_on_bounded_runs(spark, docs, monkeypatch):
    """Rows and words handled at once do not follow the batch, and the hits stay the same."""
    lists = pa.array([["a"] * n for n in (3, 0, 9, 2, 2, 1)] + [None], pa.list_(pa.string()))
    monkeypatch.setattr(search, "RUN_TOKENS", 4)
    assert search.token_runs(lists, 2) == [(0, 2), (2, 3), (3, 5), (5, 7)]
    assert search.token_runs(lists.slice(0, 0), 2) == []
    rows, df = docs
    q = spark.createDataFrame(QUERIES, "query_id string, workspace_id string, text string")
    found = search.bm25_topk(df, q, 7).collect()
    for query, ws, text in QUERIES:
        mine = sorted((-r["score"], r["message_id"]) for r in found if r["query_id"] == query)
        want = brute_bm25(rows, ws, text, 7)
        assert [i for _, i in mine] == [i for _, i in want]
        assert [-s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=1e-8)
