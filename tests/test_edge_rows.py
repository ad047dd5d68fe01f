"""Rows at the edge: odd separators and white space, null scopes, ids of other types, repeated keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as tx
from talkweave.operators import fusion, ingest, search
from talkweave.sources import exports, tables

SEPARATORS = ("\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029")


def test_line_separators_lose_no_message(spark):
    text = "\n".join(f"01/02/2024, 10:0{i} - {who}: left{sep}right" for i, (who, sep) in enumerate(zip("ABCDEF", SEPARATORS)))
    lines = exports.explode_lines(spark.createDataFrame([("w", text)], "workspace_id string, text string"))
    messages, rejects = ingest.parse_exports(lines)
    assert [(r.sender, r.text) for r in messages.orderBy("seq").collect()] == [(who, "left\nright") for who in "ABCDEF"]
    assert rejects.isEmpty()


def test_unsplit_lines_lose_no_message(spark):
    rows = [("w", i, f"01/02/2024, 10:0{i} - {who}: left{sep}right") for i, (who, sep) in enumerate(zip("ABCDEF", SEPARATORS))]
    messages, _ = ingest.parse_exports(spark.createDataFrame(rows, "workspace_id string, seq bigint, line string"))
    assert [r.sender for r in messages.orderBy("seq").collect()] == list("ABCDEF")


def test_readers_agree_on_ids_and_lines(spark, scratch):
    folder = os.path.join(scratch, "odd")
    os.makedirs(folder)
    with open(os.path.join(folder, "Chat with Bob+Zoë 100%.txt"), "w", encoding="utf-8", newline="") as out:
        out.write("01/02/2024, 10:00 - A: a\u2028b\r\n01/02/2024, 10:01 - B: c\x85d\rlast")
    with open(os.path.join(folder, "old.txt"), "wb") as out:
        out.write(b"01/02/2024, 10:00 - Zo\xeb: caf\xe9\x85next")
    whole = {tuple(r) for r in exports.explode_lines(exports.read_exports(spark, folder)).collect()}
    split = {tuple(r) for r in exports.read_export_lines(spark, folder).select("workspace_id", "seq", "line").collect()}
    assert whole == split
    assert {r[0] for r in whole} == {"Chat with Bob+Zoë 100%", "old"} and ("old", 1, "next") in whole and len(whole) == 7


def test_white_space_of_every_kind(spark):
    texts = ["\u3000a\u2003b\u00a0", "\u2003\x85", " c\x1cd ", "\u200ae"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(tx.strip(F.col("t")), tx.word_count(F.col("t")), tx.normalise(F.col("t")), tx.is_noise(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(t.strip(), len(t.split()), " ".join(t.split()), t.strip() == "") for t in texts]


@pytest.mark.parametrize("limit", [4096, 0])
def test_both_vector_paths_agree_on_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "PACKED_REQUESTS", limit)
    kind = "workspace_id string, person_id string, embedding array<double>"
    rng = np.random.default_rng(3)
    vectors = [(i, "a", "p", rng.standard_normal(4 if i % 2 else 3).tolist()) for i in range(40)]
    vectors += [(90, None, "a", [1.0, 0.0, 0.0]), (91, "a", None, [1.0, 0.0, 0.0]), (92, "a", "p", None), (93, "a", "p", [])]
    asked = [(1, "a", "p", [1.0, 2.0, 3.0]), (2, "a", "p", [1.0, 2.0, 3.0, 4.0]), (3, None, "a", [1.0, 0.0, 0.0]), (4, "a", None, [1.0, 0.0, 0.0]), (5, "a", "p", None), (6, "a", "p", [1.0])]
    found = search.cosine_topk(
        spark.createDataFrame(vectors, f"message_id int, {kind}"), spark.createDataFrame(asked, f"query_id int, {kind}"), 5, ["workspace_id", "person_id"]
    )
    assert dict(found.dtypes)["query_id"] == "int"
    expected = []
    for q, _, _, want in asked[:2]:
        w = np.array(want) / np.linalg.norm(want)
        scored = [(-round(float(np.array(v) / np.linalg.norm(v) @ w), 9), m) for m, _, _, v in vectors[:40] if len(v) == len(want)]
        expected += [(q, m, rank) for rank, (_, m) in enumerate(sorted(scored)[:5], 1)]
    assert [(r.query_id, r.message_id, r["rank"]) for r in found.orderBy("query_id", "rank").collect()] == expected


def test_keyword_search_takes_int_ids(spark):
    corpus = spark.createDataFrame([("w", 1, "red fox"), ("w", 2, "blue fox fox")], "workspace_id string, message_id int, text string")
    queries = spark.createDataFrame([(7, "w", "blue")], "query_id int, workspace_id string, text string")
    assert [(r.query_id, r.message_id) for r in search.bm25_topk(corpus, queries).collect()] == [(7, 2)]


def test_blank_phrasings_and_repeated_ids(spark):
    corpus = spark.createDataFrame(
        [(w, "m", f"fox of {w}", "S", None) for w in ("a", "b")], "workspace_id string, message_id string, text string, speaker string, ts timestamp_ntz"
    )
    vectors = spark.createDataFrame([("a", "m", "p", [1.0, 0.0]), ("b", "m", "p", [1.0, 0.0])], "workspace_id string, message_id string, person_id string, embedding array<double>")
    columns = "request_id int, query_id int, workspace_id string, person_id string, speaker string, intent string, text string, embedding array<double>"
    queries = spark.createDataFrame(
        [(1, 1, "a", "p", "S", "neutral", "  fox\u3000", [1.0, 0.0]), (1, 2, "a", "p", "S", "neutral", " \u2003", [1.0, 0.0])], columns
    )
    legs = fusion.retrieval_legs(corpus, vectors, queries)
    assert {r.query_id for r in legs.collect()} == {1}
    out = fusion.fast_retrieve(corpus, vectors, queries, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert [(r.message_id, r.query_count, r.snippet) for r in out] == [("m", 1, "fox of a")]


def test_upsert_takes_one_change_per_key(spark):
    schema = "id int, v array<int>"
    current = spark.createDataFrame([(1, [1]), (2, [2])], schema)
    changes = spark.createDataFrame([(2, [3]), (2, [4]), (3, [5])], schema)
    first, again = (sorted((r.id, r.v) for r in tables.upsert(current, df, ["id"]).collect()) for df in (changes, changes.repartition(5)))
    assert first == again and [i for i, _ in first] == [1, 2, 3] and first[1][1] in ([3], [4])
