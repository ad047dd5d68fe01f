"""Empty tables, clashing extra columns and very long texts, for the operators whose other tests lack them."""

import pytest
from pyspark.sql import functions as F

from talkweave.llm import contamination, html, quotes, repetition, secrets, tokens, toxicity

CLASHES = "id string, digest int, s string, spans int, label string, level int, passage string, hash int, node int, score string, `a.b` int"
VALUES = ("x", 1, "y", 2, "z", 3, "p", 4, 5, "q", 6)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, *VALUES) for i, t in enumerate(texts)], f"doc_id bigint, text string, {CLASHES}")


def talk(spark, rows):
    return spark.createDataFrame([(*r, *VALUES) for r in rows], f"conv_id bigint, turn bigint, role string, text string, {CLASHES}")


def test_empty_tables(spark):
    none = documents(spark, ["x"]).limit(0)
    assert none.select(repetition.repetition(F.col("text")).alias("r")).count() == 0
    assert quotes.link_quotes(talk(spark, [(1, 0, "a", "x")]).limit(0)).count() == 0
    from public_tokenizers import path

    assert none.select(tokens.token_count(spark, F.col("text"), path("byte_bpe_50k.json"))).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(none, labels, F.lit(False)).count() == 0


def test_clashing_columns(spark):
    from public_tokenizers import path

    docs = documents(spark, ["hello there", None, "", "you trash"])
    labels = spark.createDataFrame([(0, 0), (3, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(docs, labels, F.col("doc_id") < 0).count() == 4
    n = docs.select("doc_id", tokens.token_count(spark, F.col("text"), path("byte_bpe_50k.json")).alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in n][1:3] == [0, 0] and n[0]["n"] > 0
    found = quotes.link_quotes(talk(spark, [(1, 0, "a", "Shall we meet there?"), (1, 1, "b", "> Shall we meet there?\nYes."), (1, 2, "c", None)])).collect()
    assert {(r["turn"], r["source_turn"]) for r in found} >= {(1, 0)}


@pytest.mark.parametrize("words", [300_000])
def test_very_long_texts(spark, words):
    body = " ".join(f"w{i % 5000}" for i in range(words))
    item = " ".join(f"w{i}" for i in range(100, 125))
    docs = documents(spark, [body, body + " password=abcdefghijklmnop", "short"])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    hit = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination.contamination(docs, bench).collect()}
    assert hit[0] == (words, 25 * words // 5000, ["1"]) and hit[2] == (1, 0, [])
    spans = {r["id"]: [s["kind"] for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert spans == {0: [], 1: ["assign"], 2: []}
    quoted = "\n".join("> " + body[i : i + 100] for i in range(0, len(body), 100))
    linked = quotes.link_quotes(talk(spark, [(1, 0, "a", quoted.replace("> ", "")), (1, 1, "b", quoted + "\nAgreed.")])).collect()
    assert {(r["turn"], r["source_turn"]) for r in linked} == {(0, None), (1, 0)}
    page = "<html><body><nav><a>Home</a></nav><article><h1>T</h1>" + "".join(f"<p>{body[i:i + 3000]}</p>" for i in range(0, 600_000, 3000)) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert len(html.main_text(pages).first()["text"]) > 500_000
