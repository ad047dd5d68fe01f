import json
import random

import pytest
from pyspark.sql import functions as F

from talkweave.functions.text import TOPICS, is_noise
from talkweave.operators import context as cx
from talkweave.operators import packing, sampling, voice


@pytest.mark.parametrize(
    "ranges, want",
    [
        ([(0, 5, 0.3), (50, 58, 0.2)], [(0, 5, 0.3), (50, 58, 0.2)]),
        ([(0, 5, 0.3), (6, 9, 0.6)], [(0, 9, 0.6)]),
        ([(0, 5, 0.3), (8, 9, 0.6)], [(0, 5, 0.3), (8, 9, 0.6)]),
        ([(0, 20, 0.1), (3, 6, 0.9), (21, 25, 0.2)], [(0, 25, 0.9)]),
        ([(4, 6, 0.1), (4, 6, 0.7)], [(4, 6, 0.7)]),
    ],
)
def test_interval_merge(spark, ranges, want):
    df = spark.createDataFrame([("r", "w", s, e, x) for s, e, x in ranges], "request_id string, workspace_id string, start bigint, end bigint, score double")
    got = [(r.start, r.end, r.score) for r in cx.merge_intervals(df, 4).orderBy("range_no").collect()]
    assert got == want


def test_interval_merge_random(spark):
    rng = random.Random(2)
    ranges = sorted((s, s + rng.randint(1, 12), round(rng.random(), 3)) for s in (rng.randint(0, 900) for _ in range(150)))
    merged = [list(ranges[0])]
    for s, e, x in ranges[1:]:
        if s <= merged[-1][1] + 2:
            merged[-1] = [merged[-1][0], max(merged[-1][1], e), max(merged[-1][2], x)]
        else:
            merged.append([s, e, x])
    df = spark.createDataFrame([("r", "w", *r) for r in ranges], "request_id string, workspace_id string, start bigint, end bigint, score double")
    got = [[r.start, r.end, r.score] for r in cx.merge_intervals(df, 16).orderBy("range_no").collect()]
    assert got == merged


@pytest.fixture(scope="module")
def talk(chat):
    rng = random.Random(9)
    words = ["yes", "ok fine", "deploy the code now please", "when is the exam tomorrow", "haha nice one yaar", "meet at five then", "<Media omitted>", "see you there my friend", "the result of the interview"]
    rows = [("w", rng.choice("ABC"), i, rng.choice(words)) for i in range(160)] + [("v", "A", i, "alone here " + str(i)) for i in range(5)]
    return rows, chat(rows)


def test_blocks_follow_score_person_and_fallback(spark, chat):
    line = cx.timeline(chat([("w", "A" if i % 7 else "Bob", i, f"t{i}") for i in range(100)]), 16)
    hits = spark.createDataFrame(
        [("r", "w", "w-50", 0.9, "A", "t50", "Zed"), ("r", "w", "w-20", 0.1, "A", "t20", "Zed"), ("r", "w", "gone", 0.8, "A", "lost text", "Zed"),
         ("s", "w", "w-20", 0.1, "A", "t20", "bob"), ("s", "w", "w-54", 0.9, "A", "t54", "bob"), ("s", "w", "w-50", 0.2, "A", "t50", "bob")],
        "request_id string, workspace_id string, message_id string, score double, speaker string, snippet string, target_person string",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {(r.request_id, r.block_no): r.text for r in cx.context_blocks(hits, line, 0.35, 5, 16).collect()}
    assert set(got) == {("r", 1), ("r", 2), ("s", 1), ("s", 2)}
    assert got[("r", 1)].splitlines() == [f"{'A' if i % 7 else 'Bob'}: t{i}" for i in range(47, 55)]
    assert got[("r", 2)] == "A (2024-01-01 00:00): lost text"
    assert got[("s", 1)].splitlines()[0] == "A: t17"
    assert len(got[("s", 2)].splitlines()) == 12
    qa = cx.context_blocks_qa(hits, line, 1, 16).filter("request_id = 's'").orderBy("pos").collect()
    assert [r.pos for r in qa] == list(range(17, 25)) and [r.pos for r in qa if r.is_hit] == [20]


def test_paired_exchanges(talk):
    rows, df = talk
    line = cx.timeline(df, 16)
    got = {(r.workspace_id, r.pos): r.exchange for r in cx.paired_exchanges(line, 8, 9).collect()}
    mine = [r for r in rows if r[0] == "w"]
    for i, (ws, sender, _, text) in enumerate(mine):
        if text.startswith("<Media"):
            assert (ws, i) not in got
            continue
        before = next((p for p in reversed(mine[max(0, i - 8) : i]) if p[1] != sender and not p[3].startswith("<Media")), None)
        head = f"[{before[1]}]: {before[3]}\n" if before else ""
        assert got[(ws, i)] == f"{head}[{sender}]: {text}"


def test_exchanges_with_late_texts(talk):
    _, df = talk
    df = df.union(df.limit(1).withColumns({"workspace_id": F.lit("alone"), "message_id": F.lit("x")}))
    whole = {tuple(r) for r in cx.paired_exchanges(cx.timeline(df, 16), 8, 9).select("workspace_id", "message_id", "pos", "exchange").collect()}
    marks = df.withColumn("readable", ~is_noise(F.col("text"))).drop("text")
    partners = cx.exchange_partners(cx.timeline(marks, 16), 8, 9)
    assert "text" not in partners.columns
    late = cx.exchange_texts(partners, df)
    assert {tuple(r) for r in late.select("workspace_id", "message_id", "pos", "exchange").collect()} == whole
    some = cx.exchange_texts(partners.filter("pos % 7 = 3"), df).select("workspace_id", "message_id", "pos", "exchange").collect()
    assert {tuple(r) for r in some} == {r for r in whole if r[2] % 7 == 3} and len(some) > 3
    assert cx.exchange_texts(partners.limit(0), df).count() == 0


def test_excerpts_spread_over_distinct_candidates(talk):
    rows, df = talk
    got = cx.conversation_snippets(cx.timeline(df, 16), 4, 6, 9).orderBy("first_pos").collect()
    for ws, sender in (("w", "A"), ("v", "A")):
        mine = [r for r in rows if r[0] == ws]
        seen = []
        for i, r in enumerate(mine):
            text = "\n".join(f"{m[1]}: {m[3]}" for m in mine[max(0, i - 6) : i + 1])
            if r[1] == sender and i >= 1 and text not in seen:
                seen.append(text)
        step = max((len(seen) - 1) // 3, 1)
        want = seen if len(seen) <= 4 else [seen[i] for i in sorted(set(range(0, len(seen), step)) | {len(seen) - 1})][:4]
        assert [r.snippet for r in got if r.workspace_id == ws and r.sender == sender] == want


def test_history_budget_and_split(spark, chat):
    df = chat([("w", "A", i, "x" * 100) for i in range(40)] + [("v", "A", i, "x" * 300) for i in range(40)])
    got = {(r.workspace_id): r.n for r in cx.history_budget(df).groupBy("workspace_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"w": 30, "v": 20}
    split = cx.summary_split(cx.timeline(df, 8)).filter("workspace_id = 'w' and use = 'verbatim'")
    assert sorted(r.pos for r in split.collect()) == list(range(30, 40))
    recent = cx.recent_turns(cx.timeline(chat([("w", "A", i, f"t{i}") for i in range(9)]), 4), 2, 4)
    assert {r.pos: r.recent for r in recent.collect()} == {0: None, 1: "t0", **{i: f"t{i-2} t{i-1}" for i in range(2, 9)}}


def spread(items, n):
    if n <= 0 or len(items) <= n:
        return items if n > 0 else []
    if n == 1:
        return [items[len(items) // 2]]
    step = max((len(items) - 1) // (n - 1), 1)
    return [items[i] for i in sorted(set(range(0, len(items), step)) | {len(items) - 1})][:n]


@pytest.mark.parametrize("size, limit", [(5, 9), (50, 10), (91, 60), (7, 3)])
def test_recency_sample(chat, size, limit):
    df = chat([("w", "A", i, str(i)) for i in range(size)])
    got = sorted(int(r.text) for r in sampling.recency_sample(sampling.person_positions(df, 8), limit).collect())
    items = list(range(size))
    if size <= limit:
        want = items
    else:
        cut = max(1, size * 2 // 3)
        recent = min(round(limit * 0.6), size - cut)
        want = spread(items[:cut], min(limit - recent, cut)) + spread(items[cut:], recent)
    assert got == sorted(want)


@pytest.mark.parametrize("limit", [3, 8, 20, 200])
def test_monthly_samples(spark, chat, limit):
    rng = random.Random(4)
    minutes = sorted(rng.randint(0, 60 * 24 * 200) for _ in range(120))
    df = chat([("w", "A", m, str(i)) for i, m in enumerate(minutes)])
    months = {r.text: r.m for r in df.select("text", F.date_format("ts", "yyyy-MM").alias("m")).collect()}
    got = sorted(int(r.text) for r in sampling.monthly_samples(df, limit, 16).collect())
    items = list(range(120))
    newest = {}
    for i in reversed(items):
        newest.setdefault(months[str(i)], i)
    picks = sorted(newest.values(), reverse=True)[:limit]
    others = [i for i in items if i not in picks]
    want = sorted(picks + spread(others, limit - len(picks))) if len(picks) < limit else sorted(picks)
    assert got == (items if limit >= 120 else want)


def ack(t):
    return len(t) <= 4 or (len(t) <= 8 and " " not in t[4:])


def topic_of(text):
    best, name = 0, "general"
    for t, words in TOPICS.items():
        n = sum(w in text for w in words)
        if n > best:
            best, name = n, t
    return name


def model_candidates(timeline, person):
    out = []
    for i, (sender, text) in enumerate(timeline):
        if sender != person or text.startswith("<Media"):
            continue
        start, window, seen = max(0, i - 1), [], set()
        for s, t in timeline[start : start + 10]:
            if t.startswith("<Media"):
                continue
            if len(seen) >= 2 and s not in seen:
                break
            seen.add(s)
            window.append((s, t))
            if len(window) >= 4:
                break
        own = [t for s, t in window if s == person]
        if not own or len(own) == len(window) or any(len(t.split()) <= 1 for _, t in window):
            continue
        if not any(len(t) > 10 and not ack(t) for t in own):
            continue
        score = (2 if len(own) >= 2 else 0) + sum(len(t) > 15 for t in own) + 1 + (2 if not all(map(ack, own)) else 0)
        out.append((i, window, topic_of(" ".join(t.lower() for _, t in window)), score))
    return out


def overlap(a, b):
    x, y = {t for _, t in a}, {t for _, t in b}
    return len(x & y) / len(x | y)


def model_samples(cands):
    groups = {}
    for _, w, topic, score in cands:
        groups.setdefault(topic, []).append((w, score))
    firsts = sorted((max(g, key=lambda x: x[1]) for g in groups.values()), key=lambda x: -x[1])
    used = {json.dumps(w) for w, _ in firsts}
    kept = []
    for w, score in firsts:
        if not any(overlap(w, k) > 0.6 for k, _ in kept):
            kept.append((w, score))
    for _, w, _, score in sorted(cands, key=lambda c: -c[3]):
        if len(kept) >= 5:
            break
        if json.dumps(w) in used or any(overlap(w, k) > 0.6 for k, _ in kept):
            continue
        used.add(json.dumps(w))
        kept.append((w, 0))
    return kept[:8]


def test_voice_candidates_and_samples(talk):
    rows, df = talk
    found = voice.voice_candidates(cx.timeline(df, 16), 16)
    pool = voice.materialise(found)
    got = {}
    for r in pool.collect():
        got.setdefault((r.workspace_id, r.sender), {})[r.pos] = ([(m.sender, m.text) for m in r.exchange], r.topic, r.score)
    samples = {(r.workspace_id, r.sender): [([(m.sender, m.text) for m in s.exchange], s.score) for s in r.samples] for r in voice.voice_samples(pool).collect()}
    line = [(s, t) for w, s, _, t in rows if w == "w"]
    for person in "ABC":
        want = model_candidates(line, person)
        assert got[("w", person)] == {i: (w, topic, score) for i, w, topic, score in want}
        assert samples[("w", person)] == model_samples(want)
    assert ("v", "A") not in got
    labelled = voice.labelled_samples(voice.voice_samples(pool))
    assert labelled.filter("sender = 'A'").first().context == "A speaking"
    assert "[A speaking]\n" in voice.dialogue_text(labelled).filter("sender = 'A'").first().dialogue


@pytest.mark.parametrize("seed", range(4))
def test_short_list_holds_all_that_a_scan_adds(spark, seed):
    """Few different texts, so that kept exchanges shut out very many others."""
    rng = random.Random(seed)
    cands = []
    for pos in range(1500):
        texts = [f"t{min(int(rng.expovariate(0.4)), 30)} words" for _ in range(rng.randint(1, 4))]
        cands.append((pos, [("A", texts[0]), *[(rng.choice("AB"), t) for t in texts[1:]]], rng.choice(["x", "x", "y"]), rng.randint(1, 9) if seed else 5))
    kind = "workspace_id string, sender string, pos bigint, exchange array<struct<sender:string,text:string>>, topic string, score bigint"
    df = spark.createDataFrame([("w", "A", *c) for c in cands], kind)
    sets = lambda w: {t for _, t in w}
    alike = lambda a, b: len(sets(a) & sets(b)) > 0.6 * len(sets(a) | sets(b))
    tops = {}
    for _, w, topic, score in cands:
        tops[topic] = max(tops.get(topic, (w, -1)), (w, score), key=lambda x: x[1])
    first = {topic: min(p for p, _, t, _ in cands if t == topic) for topic in tops}
    kept = []
    for topic in sorted(tops, key=lambda t: (-tops[t][1], first[t])):
        if not any(alike(tops[topic][0], k) for k, _ in kept):
            kept.append(tops[topic])
    for _, w, _, score in sorted(cands, key=lambda c: (-c[3], c[0])):
        if len(kept) < 5 and not any(alike(w, k) for k, _ in kept):
            kept.append((w, 0))
    got = voice.voice_samples(df).first()["samples"]
    assert [([(m["sender"], m["text"]) for m in s["exchange"]], s["score"]) for s in got] == kept


def test_a_message_is_examined_once_and_not_in_every_window(spark):
    """Patterns and keywords are asked for below the window that hands a message to ten exchanges."""
    df = spark.createDataFrame([], "workspace_id string, pos bigint, sender string, text string")
    lines = voice.voice_candidates(df, 16)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    costly = [i for i, line in enumerate(lines) if "RLIKE" in line or "Contains(" in line or "regexp" in line]
    assert costly and min(costly) > window


def test_samples_are_chosen_without_their_texts(spark):
    kind = "workspace_id string, sender string, pos bigint, exchange array<struct<sender:string,text:string>>, topic string, score bigint"
    plan = voice.voice_samples(spark.createDataFrame([], kind))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [" in line and "exchange" in line for line in plan.split("\n")) == 1


def test_plan_of_samples_does_not_grow_with_their_number(spark):
    kind = "workspace_id string, sender string, pos bigint, exchange array<struct<sender:string,text:string>>, topic string, score bigint"
    df = spark.createDataFrame([], kind)
    size = lambda n: voice.voice_samples(df, n, 40)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(2) == size(12)


@pytest.mark.parametrize("block", [11, 64, 1000])
@pytest.mark.parametrize("heavy", [False, True])
def test_packing(spark, block, heavy, monkeypatch):
    monkeypatch.setattr(packing, "RUN_BLOCKS", 3)
    rng = random.Random(block)
    parts = {"hot": 500, "a": 30, "b": 1, "edge": block}
    data = [(p, i, rng.randint(1, 400 if heavy else 40)) for p, n in parts.items() for i in range(n)]
    df = spark.createDataFrame(data, "person string, pos bigint, tokens bigint")
    got = {(r.person, r.pos): r.chunk_no for r in packing.pack(df, ["person"], 10, 300, block).collect()}
    for p in parts:
        chunk, items, used = 0, 0, 0
        for person, pos, tokens in data:
            if person != p:
                continue
            if items and (items >= 10 or used + tokens > 300):
                chunk, items, used = chunk + 1, 0, 0
            items, used = items + 1, used + tokens
            assert got[(p, pos)] == chunk


def test_a_dialogue_is_one_text_on_both_sides_of_a_block(spark):
    rows = [("w", 65535, "user", "a"), ("w", 65536, "Mia", "b"), ("v", 1, "Mia", "c")]
    got = cx.flatten_dialogue(spark.createDataFrame(rows, "workspace_id string, seq bigint, sender string, text string")).collect()
    assert sorted((r.workspace_id, r.dialogue) for r in got) == [("v", "Mia: c"), ("w", "User: a\nMia: b")]
