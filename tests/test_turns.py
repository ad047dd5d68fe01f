import random

import pytest
from pyspark.sql import functions as F

from talkweave.operators import analytics as an
from talkweave.operators import turns as tn

NAMES = ["Ana", "Ann Lee", "Bo", "Cy"]


def model_turns(rows):
    turns = []
    for ws, sender, minute, text in rows:
        if turns and turns[-1]["ws"] == ws and turns[-1]["sender"] == sender:
            turns[-1]["n"] += 1
            turns[-1]["text"] += " " + text
        else:
            turns.append({"ws": ws, "sender": sender, "first": minute * 60, "n": 1, "text": text})
    return turns


def model_events(turns):
    out, previous = [], None
    for t in turns:
        if previous is None:
            kind, gap = "first", None
        else:
            gap = t["first"] - previous["first"]
            if gap < 0:
                kind = "skip"
            elif gap > 1800:
                kind = "pickup" if gap <= 14400 else "initiation"
            else:
                kind = "burst"
        out.append((t["sender"], gap, kind))
        previous = t
    return out


@pytest.fixture(scope="module")
def random_chat(chat):
    rng = random.Random(11)
    per_ws = {}
    for ws, n in (("hot", 600), ("small", 9)):
        minute, rows = 0, []
        for _ in range(n):
            minute += rng.choice([0, 0, 1, 3, 20, 31, 200, 300, -2])
            text = rng.choice(["hello there", "see @ann lee now", "mail a@bo.example", "@Ann", "Lee", "ok ok", "@CYrus hi"])
            rows.append((ws, rng.choice(NAMES[: 4 if ws == "hot" else 2]), minute, text))
        per_ws[ws] = rows
    return per_ws, chat(per_ws["hot"] + per_ws["small"], skip=3)


def test_turns_across_blocks(random_chat):
    per_ws, df = random_chat
    got = {(r.workspace_id, r.turn_no): r for r in tn.turns(df, 16).collect()}
    texts = {}
    for r in sorted(tn.turn_texts(df, 16).collect(), key=lambda r: r.part_no):
        texts.setdefault((r.workspace_id, r.turn_no), []).append(r.text)
    for ws, rows in per_ws.items():
        want = model_turns(rows)
        assert sum(1 for k in got if k[0] == ws) == len(want)
        for i, t in enumerate(want):
            row = got[(ws, i)]
            assert (row.sender, row.msg_count, row.text_length) == (t["sender"], t["n"], len(t["text"]))
            assert " ".join(texts[(ws, i)]) == t["text"]


def test_events_across_blocks(random_chat):
    per_ws, df = random_chat
    events = tn.turn_events(tn.turns(df, 16), 8)
    got = {(r.workspace_id, r.turn_no): (r.sender, r.gap_seconds, r.kind) for r in events.collect()}
    for ws, rows in per_ws.items():
        assert [got[(ws, i)] for i in range(len(model_turns(rows)))] == model_events(model_turns(rows))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_parts_of_a_turn_are_counted_from_its_first_message(chat, block):
    df = chat([("w", "A", 0, "x")] + [("w", "B", i, f"b{i}") for i in range(1, 24)] + [("w", "A", 30, "y"), ("v", "A", 0, "z")])
    got = {(r.workspace_id, r.turn_no, r.part_no): r.text for r in tn.turn_texts(df, block, part=10).collect()}
    parts = [" ".join(f"b{i}" for i in range(1 + k, min(11 + k, 24))) for k in (0, 10, 20)]
    assert got == {("w", 0, 0): "x", ("w", 1, 0): parts[0], ("w", 1, 1): parts[1], ("w", 1, 2): parts[2], ("w", 2, 0): "y", ("v", 0, 0): "z"}


def test_mentions_run_over_messages_and_blocks(random_chat):
    per_ws, df = random_chat
    people = tn.people_of(df)
    got = {(r.workspace_id, r.turn_no): r.mentioned for r in tn.mentions(df, people, 16).collect()}
    want = {}
    for i, t in enumerate(model_turns(per_ws["hot"])):
        hit = [n for n in sorted(NAMES) if n != t["sender"] and "@" + n.lower() in t["text"].lower()]
        if hit:
            want[("hot", i)] = hit[0]
    assert got == want  # the two-person chat attributes nothing
    assert any(v == "Ann Lee" for v in want.values())


@pytest.mark.parametrize("block", [2, 4, 4096])
def test_names_may_run_over_any_number_of_messages(chat, block):
    long = " ".join("abcdefghij"[i % 10] for i in range(41))
    rows = [("w", "A", 0, "hi @a"), ("w", "B c d", 1, "yo @A"), ("w", "C", 2, "hm @b c d"), ("w", long, 3, "x@"), ("w", long, 4, "b c d @B"), ("w", long, 5, "C D, no")]
    rows += [("w", "A", 6 + i, ("@@" if i == 0 else "") + x) for i, x in enumerate(long.split())]
    rows += [("v", "P", 0, "@q"), ("v", "Q", 1, "@p")]  # two speakers mention nobody
    df = chat(rows)
    got = {(r.workspace_id, r.turn_no): r.mentioned for r in tn.mentions(df, tn.people_of(df), block).collect()}
    assert got == {("w", 1): "A", ("w", 2): "B c d", ("w", 3): "B c d", ("w", 4): long}


def test_tails_of_a_long_text_hold_no_more_than_a_name(chat):
    """The work grows with the text: one bounded tail per ``@``."""
    df = chat([("w", n, i, "x") for i, n in enumerate(("Ann", "Bo", "Cy"))] + [("w", "Cy", 9, "@ann " * 20_000 + "@b"), ("w", "Cy", 10, "o")])
    people = tn.people_of(df)
    numbered = tn.number_turns(df.select("workspace_id", "seq", "sender", "ts", "text"), 16)
    tails = [r["tail"] for r in tn.at_tails(numbered, people, 16).collect()]
    assert set(tails) == {"ann", "b o"}
    assert [r["mentioned"] for r in tn.mentions(df, people, 16, numbered).collect()] == ["Ann"]


def test_pause_can_split_turns(chat):
    df = chat([("w", "A", 0, "one"), ("w", "A", 300, "two"), ("w", "B", 301, "three")])
    assert tn.turns(df, 2).count() == 2
    split = tn.turn_events(tn.turns(df, 2, split_after_seconds=1800), 2)
    assert [r.kind for r in split.orderBy("turn_no").collect()] == ["first", "initiation", "burst"]


def test_reply_rules(chat):
    """Four-hour cap, zero gaps counted but not timed, medians from three samples."""
    rows, minute = [], 0
    for gap in (60, 60, 60, 60, 241, 0):
        rows += [("w", "A", minute, "hi"), ("w", "B", minute + gap, "yo")]
        minute += gap + 600
    events = tn.turn_events(tn.turns(chat(rows), 4), 4).cache()
    medians = {r.sender: r for r in an.reply_medians(events).collect()}
    assert medians["B"].pickup_median == 3600.0
    assert medians["A"].pickup_median is None and medians["A"].burst_median is None
    given = {r.sender: (r.replies_given, r.replies_received) for r in an.replies_given_received(events).collect()}
    assert given["B"] == (5, 0) and given["A"] == (0, 5)
    bins = {r.label: r.replies for r in an.response_histogram(events).filter("sender = 'B'").collect()}
    assert bins == {"<1m": 0, "1-5m": 0, "5-30m": 0, "30m+": 0}


def test_scorecard_matches_parts(random_chat):
    _, df = random_chat
    events = tn.turn_events(tn.turns(df, 16), 8)
    card = {(r.workspace_id, r.sender): r for r in an.person_scorecard(df, events).collect()}
    counts = an.sender_share(an.sender_counts(df)).collect()
    started = {(r.workspace_id, r.sender): r.initiations for r in an.initiations(events).collect()}
    assert len(card) == len(counts)
    for r in counts:
        row = card[(r.workspace_id, r.sender)]
        assert row.message_count == r.message_count
        assert row.share_percent == pytest.approx(r.share_percent)
        assert row.initiations == started[(r.workspace_id, r.sender)]


def test_week_keys_at_year_ends(spark):
    df = spark.sql("select 'w' workspace_id, timestamp_ntz'2024-12-30 10:00:00' ts union all select 'w', timestamp_ntz'2021-01-01 10:00:00'")
    got = {(r.week, r.label) for r in an.weekly_series(df).collect()}
    assert got == {("2025-W01", "Dec 30"), ("2020-W53", "Dec 28")}


def test_dense_heatmap_has_every_cell(chat):
    df = chat([("w", "A", 61, "hi"), ("w", "B", 62, "ho")])
    cells = an.dense_heatmap(an.activity_counts(df, "workspace_id")).collect()
    assert len(cells) == 168 and sum(c.message_count for c in cells) == 2


def test_person_id_is_stable(chat):
    df = chat([("w", "A", 0, "hi")])
    first, second = (an.people_roster(df).first().person_id for _ in range(2))
    assert first == second and len(first) == 64


def test_usable_filter(spark, chat):
    df = chat([("w", "A", 0, t) for t in ("hi", " ", "<media omitted>", "[message deleted]", "GIF omitted", "image  omitted ", "This message was deleted.", "not omitted")])
    kept = [r.text for r in tn.usable_messages(df.withColumn("is_system", F.lit(False))).collect()]
    assert sorted(kept) == ["hi", "not omitted"]
