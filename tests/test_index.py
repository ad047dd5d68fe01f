"""Searches of a stored index against brute force, what they read and what they skip."""

import random

import pytest
from pyspark.sql import functions as F

from talkweave.operators import index, search
from test_search import QUERIES, WORDS, brute_bm25


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(rng.choice(["hot", "hot", "cold"]), i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    made += [("hot", 1000 + i, "beach beach sunny") for i in range(100)]  # copies tie on purpose
    return made + [("hot", 2000, ""), ("cold", 2001, "!!"), ("hot", 2002, "rain " * 20_000)]


def built(spark, scratch, rows, monkeypatch, per_range, kind="bigint"):
    monkeypatch.setattr(index, "RANGE_MESSAGES", per_range)
    df = spark.createDataFrame([(w, i if kind == "bigint" else f"m{i:05}", t) for w, i, t in rows], f"workspace_id string, message_id {kind}, text string")
    index.write_index(df.repartition(5), scratch + "/bm25")
    return index.Index(spark, scratch + "/bm25", kind)


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id string, workspace_id string, text string")


@pytest.mark.parametrize("per_range,kind,k", [(8, "bigint", 7), (4096, "string", 7), (16, "string", 150), (1, "bigint", 3)])
def test_same_hits_as_brute_force(spark, scratch, rows, monkeypatch, per_range, kind, k):
    found = built(spark, scratch, rows, monkeypatch, per_range, kind).search(asked(spark), k).orderBy("rank").collect()
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"m{i:05}")
    for query, ws, text in QUERIES:
        want = brute_bm25(rows, ws, text, k)
        mine = [(r["score"], r["message_id"]) for r in found if r["query_id"] == query]
        assert [i for _, i in mine] == [name(i) for _, i in want]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=1e-8)


def test_ranges_below_the_bar_are_skipped(spark, scratch, monkeypatch):
    rng = random.Random(2)
    rows = [("w", i, " ".join(["needle"] * (i % 50 == 0) + [rng.choice(WORDS) for _ in range(rng.choice([2, 20, 200]))])) for i in range(2000)]
    made = built(spark, scratch, rows, monkeypatch, 50)
    terms = search.query_terms(spark.createDataFrame([(1, "w", "needle beach")], "query_id int, workspace_id string, text string"))
    ranges = index.asked_ranges(made.blocks(), terms)
    best = index.top_rows(ranges, ["query_id"], [F.col("bound").desc()], 2)
    near = index.score_ranges(made.blocks(), terms, best, 3)
    assert near.groupBy("query_id").count().first()["count"] <= 2 * 3
    bar = index.top_rows(near, ["query_id"], [F.col("score").desc()], 3).where("rank = 3").select("query_id", F.col("score").alias("bar"))
    left = index.open_ranges(ranges, best, bar)
    assert left.count() < ranges.count() / 2
    # No skipped range holds a better message.
    skipped = ranges.join(left, ["band", "part"], "left_anti").join(best, ["band", "part"], "left_anti")
    held = index.score_ranges(made.blocks(), terms, skipped, 1).agg(F.max("score")).first()[0]
    assert held is None or held < bar.first()["bar"]


def test_a_search_reads_blocks_of_its_terms_only(spark, scratch, rows, monkeypatch):
    made = built(spark, scratch, rows, monkeypatch, 64)
    plan = made.search(asked(spark), 5)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    scans = [x for x in physical.split("\n") if "FileScan" in x]
    assert scans and all("text" not in x.split("ReadSchema:")[1] for x in scans)
    heads = [x for x in scans if "ids" not in x.split("ReadSchema:")[1]]
    assert heads and all("bucket" in x for x in scans)
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical


def test_odd_rows(spark, scratch, monkeypatch):
    rows = [("w", 1, None), (None, 2, "a b"), ("w", None, "a"), ("w", 3, "a"), ("v", 3, "a b")]
    made = built(spark, scratch, rows, monkeypatch, 4)
    queries = spark.createDataFrame([(1, "w", "a a A"), (2, "nowhere", "a"), (3, "v", None), (4, None, "a")], "query_id int, workspace_id string, text string")
    assert [(r["query_id"], r["message_id"]) for r in made.search(queries).collect()] == [(1, 3)]
    assert made.search(queries.limit(0)).count() == 0
    empty = built(spark, scratch + "/none", [], monkeypatch, 4)
    assert empty.search(queries).count() == 0


def test_postings_of_ranges_shuffle_no_row_per_word(spark, rows, monkeypatch):
    """The same postings as those counted word by word, of repeated, empty and odd rows too."""
    monkeypatch.setattr(index, "RANGE_MESSAGES", 16)
    odd = [(None, 5, "a b"), ("odd", None, "a a"), ("odd", 7, None), ("odd", 8, "b a"), ("odd", 8, "b c"), ("odd", 8, "b")]
    tokens = search.tokenised(spark.createDataFrame(rows + odd, "workspace_id string, message_id bigint, text string").repartition(5))
    counted = index.counted_postings(tokens)
    names = ["workspace_id", "term", "message_id", "tf", "dl"]
    got = counted.select("workspace_id", "term", F.inline(F.arrays_zip("ids", "tfs", "dls"))).toDF("workspace_id", "term", "message_id", "tf", "dl")
    want = search.postings(tokens).filter("workspace_id is not null")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(map(tuple, want.select(*names).collect()), key=key)
    stats = {(r.workspace_id, r.term): (r.df, pytest.approx(r.idf), pytest.approx(r.avgdl)) for r in search.term_stats(tokens).collect()}
    told = counted.select("workspace_id", "term", "df", "idf", "avgdl").distinct().collect()
    # ``term_stats`` counts the rows of a message handed over twice, postings count its lengths.
    assert all(stats[r.workspace_id, r.term] == (r.df, r.idf, r.avgdl) for r in told if r.workspace_id != "odd")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_postings_are_shuffled_once_and_searches_leave_other_terms_in_place(spark, scratch, rows, monkeypatch):
    corpus = spark.createDataFrame(rows, "workspace_id string, message_id bigint, text string")
    plan = index.index_blocks(corpus)._jdf.queryExecution().executedPlan().toString()
    # Postings are made once and dealt to their files; no join moves them before.
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning(bucket") == 1 and "SortMergeJoin" not in plan
    made = built(spark, scratch, rows, monkeypatch, 64)
    physical = made.search(asked(spark), 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [bucket" in physical and "SortMergeJoin [bucket" not in physical


def test_more_terms_than_may_travel(spark, scratch, rows, monkeypatch):
    monkeypatch.setattr(index, "SMALL_STATS", 0)
    found = built(spark, scratch, rows, monkeypatch, 16).search(asked(spark), 7).orderBy("rank").collect()
    for query, ws, text in QUERIES:
        assert [r["message_id"] for r in found if r["query_id"] == query] == [i for _, i in brute_bm25(rows, ws, text, 7)]
