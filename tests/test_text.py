import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from talkweave.functions import model_output as mo
from talkweave.functions import scores as sc
from talkweave.functions import text as tx
from talkweave.operators import prompts, routing, style


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_routes(spark):
    cases = {
        "": "casual", "k": "casual", "lol": "casual", "😂😂 !": "casual", "got it": "casual", "nice pic": "casual",
        "job kya?": "ambiguous", "MAC D?": "ambiguous", "yaad hai woh trip?": "memory", "kab tha": "memory",
        "what did we eat": "memory", "I was at the market all day long": "ambiguous", "remembering things is hard for me": "ambiguous",
        "us  din mile": "memory", "really?": "ambiguous", "purana ghar dekha tha kya": "ambiguous", "purane ghar ki photo bhejo": "memory",
    }
    assert dict(zip(cases, values(spark, list(cases), routing.route))) == cases


def test_acks_and_topics(spark):
    assert values(spark, ["ok", "okkk ", "hello", "hey yo u", "abcd efg", "abcdefgh", "a longer text"], tx.is_pure_ack) == [
        True, True, True, False, False, True, False,
    ]
    assert values(spark, ["push the code", "exam kal", "zzz", "yaar"], tx.topic_bucket) == ["project_work", "scheduling", "general", "social_casual"]


def test_density(spark):
    texts = ["ok", "x" * 50, "Plan for Delhi is set for the 12th, and we all meet there early in the day" + " and so on" * 15, "a\nb\nc" + "d" * 40]
    assert values(spark, texts, tx.chunk_density) == pytest.approx([-0.04, 0.0, 0.06, 0.01])


def test_rates(spark):
    assert values(spark, ["😀ab🎉", ""], tx.emoji_rate) == pytest.approx([0.5, 0.0])
    assert values(spark, ["yaar KYA bolta", "plain words here", "हाँ", "yaari"], tx.codemix_ratio) == pytest.approx([1.0, 0.0, 1.0, 0.0])


def test_labels(spark):
    df = spark.createDataFrame([(0, 0), (45, 9), (60, 12), (200, 13), (7500, 23), (7200, 1)], "s int, h int")
    got = [(r.a, r.b) for r in df.select(sc.duration_label(F.col("s")).alias("a"), sc.hour_label(F.col("h")).alias("b")).collect()]
    assert got == [("0s", "12 AM"), ("45s", "9 AM"), ("1m", "12 PM"), ("3m 20s", "1 PM"), ("2h 5m", "11 PM"), ("2h", "1 AM")]


def test_recency(spark):
    df = spark.sql("select explode(array(10, 60, 120, 400)) d").withColumn("ts", F.expr("timestamp_ntz'2025-01-01' - make_dt_interval(d, 0, 0, 0)"))
    as_of = F.lit("2025-01-01").cast("timestamp_ntz")
    for intent, want in (("current", [0.1, 0.05, 0, 0]), ("historical", [-0.03, 0, 0, 0.05]), ("neutral", [0.05, 0.02, 0, 0])):
        got = [r.v for r in df.orderBy("d").select(sc.recency_delta(F.col("ts"), as_of, F.lit(intent)).alias("v")).collect()]
        assert got == pytest.approx(want)


def test_gates(spark):
    df = spark.createDataFrame([(1, 1, 0.35), (1, 5, 0.34), (2, 1, 0.22), (2, 1, 0.21), (2, 2, 0.1431), (2, 2, 0.14)], "n int, seen int, s double")
    got = [r.v for r in df.select(sc.passes_gate(F.col("s"), sc.dual_gate(F.col("n"), F.col("seen"))).alias("v")).collect()]
    assert got == [True, False, True, False, True, False]
    assert spark.range(1).select(sc.passes_gate(F.lit(None), 0.0).alias("v")).first().v is True


def test_score_coercion(spark):
    raw = ["0.7", "3", "-1", '"85%"', '"0.4"', '"high"', "[0.2, 1]", "[]", '{"score": [0.3]}', '{"relevance": "50"}', '{"value": {"score": 1}}', '{"x": 1}', "true", "null", "{bad"]
    got = values(spark, raw, lambda t: mo.coerce_score(F.try_parse_json(t)))
    assert got == [0.7, 1.0, 0.0, 0.85, 0.4, None, 0.2, None, 0.3, 0.5, 1.0, None, None, None, None]


@pytest.mark.parametrize("depth", [5, 50, 200])
def test_scores_nested_to_any_depth(spark, depth):
    nest = lambda opening, closing: opening * depth + '"70%"' + closing * depth
    got = values(spark, [nest("[", "]"), nest('{"score": ', "}"), nest('[{"value": ', "}]"), "[" * depth + "]" * depth], lambda t: mo.coerce_score(F.try_parse_json(t)))
    assert got == [0.7, 0.7, 0.7, None]


def test_rerank_parse(spark):
    rows = [
        ("a", 'Sure\n```json\n[{"id": 1, "score": 0.9}, {"id": "2", "score": "80%"}]\n```', 3),
        ("b", '[{"id": 4, "score": 1}, {"id": 0, "score": 1}, {"id": 3, "score": true}, "x", {"score": 1}]', 3),
        ("c", "no json", 3),
        ("d", '[{"id": 1, "score": 0.2}, {"id": 1, "score": 0.6}, {"id": 2.0, "score": [0.5]}]', 3),
    ]
    df = spark.createDataFrame(rows, "key string, raw string, chunk_count int")
    got = {(r.key, r.ordinal): r.score for r in mo.parse_rerank(df, "key").collect()}
    assert got == {("a", 1): 0.9, ("a", 2): 0.8, ("d", 1): 0.6, ("d", 2): 0.5}


def test_classification(spark):
    raw = [
        '{"needs_history": true, "needs_rewrite": true, "query_intent": "CURRENT", "search_queries": [" a ", "", "b"]}',
        '{"needs_history": true, "search_query": "old form"}',
        '{"needs_history": false, "needs_rewrite": true, "query_intent": "current"}',
        '```json\n{"needs_history": true, "query_intent": "odd", "search_queries": []}\n```',
        "not json",
    ]
    got = values(spark, raw, lambda t: mo.parse_classification(t, F.lit(" Hello ")))
    assert [(r.needs_history, r.needs_rewrite, r.query_intent, r.queries) for r in got] == [
        (True, True, "current", ["a", "b"]),
        (True, False, "neutral", ["old form"]),
        (False, False, "neutral", []),
        (True, False, "neutral", ["hello"]),
        (False, False, "neutral", []),
    ]


def test_query_lists(spark):
    df = spark.sql("select array('r1','r2','') r, array('c1','r1','c3') c, 'raw' o")
    row = df.select(
        mo.interleave(F.col("r"), F.col("c"), F.col("o")).alias("a"),
        mo.interleave(F.col("r"), F.col("c"), F.lit("c1"), 3).alias("b"),
        mo.query_terms(F.array(F.lit("a b a"), F.lit(" b  c"))).alias("t"),
        mo.query_list(F.lit(" x \n\n y\nz\nw"), F.lit("q")).alias("l"),
        mo.query_list(F.lit(" \n "), F.lit("q")).alias("e"),
        tx.split_bursts(F.lit("hi || a\n\n\nb ||  || c")).alias("p"),
        mo.sane_rewrites(F.lit("ey?"), F.lit("internship in delhi"), F.array(F.lit("build trust"))).alias("s0"),
        mo.sane_rewrites(F.lit("ey?"), F.lit("internship in delhi"), F.array(F.lit("Delhi plans"))).alias("s1"),
        mo.sane_rewrites(F.lit("ey?"), F.lit("of in"), F.array(F.lit("build trust"))).alias("s2"),
        mo.sane_rewrites(F.lit("one two three four"), F.lit("internship"), F.array(F.lit("build"))).alias("s3"),
        mo.context_query(F.lit("kaha lagi?"), F.lit("at the firm"), 4).alias("c0"),
        mo.context_query(F.lit("a b c d e"), F.lit("at the firm"), 4).alias("c1"),
        tx.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"),
    ).first()
    assert row.a == ["r1", "c1", "r2", "c3", "raw"] and row.b == ["r1", "c1", "r2"]
    assert row.t == ["a", "b", "c"] and row.l == ["x", "y", "z"] and row.e == ["q"] and row.p == ["hi", "a b", "c"]
    assert (row.s0, row.s1, row.s2, row.s3) == ([], ["Delhi plans"], ["build trust"], ["build"])
    assert row.c0 == "kaha lagi? at the firm" and row.c1 is None and row.j == pytest.approx(1 / 3)


def test_prompt_cap_and_merge(spark):
    df = spark.createDataFrame(
        [("w", "A", "l" * 1000, "a" * 1000, "w" * 1000, "p" * 100, "v" * 900, ["s"] * 5), ("w", "B", "l", "a", None, "p", "v", ["s"] * 5)],
        "workspace_id string, sender string, listening string, analysis string, writing string, personality string, voice string, samples array<string>",
    )
    out = {r.sender: r for r in prompts.cap_samples(prompts.cap_sections(df, ["voice"], 2500), "samples").collect()}
    assert (out["A"].size, out["A"].capped_size, out["A"].listening, out["A"].analysis, len(out["A"].writing)) == (4000, 2000, "", "", 1000)
    assert out["B"].capped_size == 4 and len(out["B"].samples) == 5
    people = spark.createDataFrame([("A", "old", "k"), ("B", "old", "k")], "sender string, notes string, other string")
    fresh = spark.createDataFrame([("A", "new"), ("B", None)], "sender string, notes string")
    got = {r.sender: (r.notes, r.other) for r in prompts.merge_profiles(people, fresh, ["sender"]).collect()}
    assert got == {"A": ("new", "k"), "B": ("old", "k")}
    rows = spark.createDataFrame([("w", "A", 2, "b"), ("w", "A", 1, "a")], "workspace_id string, sender string, pos int, exchange string")
    made = prompts.prompt_rows(rows).collect()
    assert len(made) == 9 and all(r.prompt.endswith("\n\na\n\nb") and "{name}" not in r.prompt for r in made)


def test_style_and_examples(spark, chat):
    df = chat([("w", "A", 0, "yaar 😀"), ("w", "A", 1, "plain"), ("w", "B", 2, "x")])
    got = {r.sender: r for r in style.style_labels(style.style_profile(df)).collect()}
    assert got["A"].avg_message_length == 5.5 and got["A"].emoji_label == "high" and got["A"].codemix_label == "high"
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, " a "), ("s", 3, " "), ("s", 4, "b"), ("s", 5, "c")], "source string, i int, text string")
    picked = style.solo_examples(rows, ["source"], "i", 2).orderBy("rank").collect()
    assert [(r.i, r.text) for r in picked] == [(1, "a"), (4, "b")]


def test_exchange_overlap_of_texts_and_words(spark, scratch):
    rows = [(1, 0, "user", "Same text"), (1, 1, "assistant", "Same text"), (2, 0, "user", "red blue"), (2, 1, "assistant", "Blue green")]
    rows += [(3, 0, "system", "rules"), (4, 0, "user", "?!"), (4, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{scratch}/conversations.parquet")
    query, sql = contract.queries()["exchange_jaccard"], contract.oracle_sql()["exchange_jaccard"]
    names = ["workspace_id", "shared", "all_elements", "jaccard", "shared_words", "all_words", "word_jaccard"]
    got = sorted(tuple(r) for r in query(spark, scratch).select(*names).collect())
    assert got == [
        ("c1", 1, 1, 1.0, 2, 2, 1.0), ("c2", 0, 2, 0.0, 1, 3, 0.333333), ("c3", 0, 0, 1.0, 0, 0, 1.0), ("c4", 0, 2, 0.0, 0, 0, 1.0),
    ]
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{scratch}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(f"select {', '.join(names)} from ({sql}) x").fetchall()) == got


def test_marks_of_parts_are_those_of_the_joined_text(spark):
    parts = [["yaar, PUSH the code", "kal exam"], ["result", "Paper"], ["zzz", "\u212aal"], ["bro", "yaar", "sad tired rest"]]
    df = spark.createDataFrame([(p, " ".join(p)) for p in parts], "parts array<string>, joined string")
    got = df.select(
        tx.topic_of_marks(F.transform("parts", lambda p: tx.topic_marks(p))).alias("a"), tx.topic_bucket(F.col("joined")).alias("b"), tx.topic_bucket(F.lit(None).cast("string")).alias("none")
    ).collect()
    assert [r.a for r in got] == [r.b for r in got] == ["project_work", "academic", "scheduling", "social_casual"]
    assert all(r.none is None for r in got)


def test_two_words(spark):
    texts = ["", " ", "a", " a ", "a b", "a\nb", "\u00a0a\u2003\u2003b", "\x1ca\x1d", "a\u200bb", "a   "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(tx.has_two_words(F.col("t")).alias("a"), (tx.word_count(F.col("t")) > 1).alias("b")).collect():
        assert r.a == r.b
