import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talkweave.operators import ingest as ig
from talkweave.sources import exports, tables

GROUP = """# notes before the first message
9/21/23, 8:23 PM - Messages are end-to-end encrypted
9/21/23, 8:24 PM - Ravi, 4C: hello there ‎<This message was edited>
second line

third line
9/21/23, 8:25 PM - Mia: This message was deleted.
This message was deleted
9/21/23, 8:26 PM - Mia: note: a: This message was deleted
31/12/2024, 23:59:07 - Mia: late
99/99/2024, 10:00 - Mia: lost
9/21/23, 20:23:11 - Mia: two-digit year with seconds
"""


def parse(spark, text, ws="w", block=4):
    lines = exports.explode_lines(spark.createDataFrame([(ws, text)], "workspace_id string, text string"))
    messages, rejects = ig.parse_exports(lines, block)
    return messages.orderBy("seq").collect(), rejects.orderBy("seq").collect()


def test_patterns(spark):
    got, rejected = parse(spark, GROUP)
    assert [(r.ts, r.sender, r.text, r.is_system) for r in got] == [
        (datetime(2023, 9, 21, 20, 23), "System", "Messages are end-to-end encrypted", True),
        (datetime(2023, 9, 21, 20, 24), "Ravi, 4C", "hello there\nsecond line\nthird line", False),
        (datetime(2023, 9, 21, 20, 25), "Mia", "[message deleted]\n[message deleted]", False),
        (datetime(2023, 9, 21, 20, 26), "Mia", "note: a: [message deleted]", False),
        (datetime(2024, 12, 31, 23, 59, 7), "Mia", "late", False),
    ]
    assert [r.raw[:20] for r in rejected] == ["99/99/2024, 10:00 - ", "9/21/23, 20:23:11 - "]
    again, _ = parse(spark, GROUP)
    assert [r.message_id for r in got] == [r.message_id for r in again]
    assert len({r.message_id for r in got}) == len(got)


def test_ios_and_day_first(spark):
    text = "[12/03/2024, 18:22:15] Asha: hi\r\n12/03/2024, 18:22 - Bo: not a header here\r\n[3/4/24, 12:05:00 am] Bo: midnight"
    got, _ = parse(spark, text)
    assert [(r.ts, r.sender, r.text) for r in got] == [
        (datetime(2024, 3, 12, 18, 22, 15), "Asha", "hi\n12/03/2024, 18:22 - Bo: not a header here"),
        (datetime(2024, 4, 3, 0, 5), "Bo", "midnight"),
    ]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_messages_do_not_follow_the_block(spark, block):
    text = "01/02/2024, 10:00 - A: l0\n" + "\n".join(f"l{i}" for i in range(1, 40)) + "\n01/02/2024, 10:01 - B: end\n\nmore"
    got, _ = parse(spark, text, block=block)
    assert [(r.seq, r.ts, r.sender, r.text) for r in sorted(got, key=lambda r: r.seq)] == [
        (0, datetime(2024, 2, 1, 10, 0), "A", "\n".join(f"l{i}" for i in range(40))), (40, datetime(2024, 2, 1, 10, 1), "B", "end\nmore"),
    ]
    assert len({r.message_id for r in got}) == 2


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_stitched_messages_do_not_follow_the_block(spark, block):
    rows = [("d", i, f"l{i}", i in (2, 6, 7, 30)) for i in range(5000)]
    got = ig.stitch_lines(spark.createDataFrame(rows, "doc string, seq bigint, line string, is_header boolean"), "doc", block).collect()
    ends = {2: 6, 6: 7, 7: 30, 30: 5000}
    assert sorted((r.header_seq, r.line_count, r.text) for r in got) == [(a, b - a, "\n".join(f"l{i}" for i in range(a, b))) for a, b in ends.items()]


def test_folder_reading_both_ways(spark, scratch):
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    rows = "".join(f"01/02/2024, 10:{i % 60:02d} - {'AB'[i % 2]}: text {i}\nmore {i}\n" for i in range(400))
    with open(os.path.join(folder, "one.txt"), "w", encoding="utf-8") as f:
        f.write(rows)
    with open(os.path.join(folder, "two.txt"), "wb") as f:
        f.write("01/02/2024, 10:00 - Zoë: café\n".encode("latin-1"))
    with open(os.path.join(folder, "skip.csv"), "w") as f:
        f.write("x")
    whole = exports.explode_lines(exports.read_exports(spark, folder)).filter("line <> ''")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        split = exports.read_export_lines(spark, folder).filter("line <> ''")
        assert split.rdd.getNumPartitions() >= 1
        a = {(r.workspace_id, r.seq, r.line) for r in whole.collect()}
        b = {(r.workspace_id, r.seq, r.line) for r in split.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    assert a == b and len(a) == 801
    assert ("two", 0, "01/02/2024, 10:00 - Zoë: café") in a


def test_message_table_replaces_only_what_comes(spark, chat, scratch):
    path = os.path.join(scratch, "messages")
    tables.write_messages(chat([("a", "A", 0, "one"), ("b", "B", 1, "two")]), path)
    tables.write_messages(chat([("b", "B", 1, "new"), ("b", "B", 2, "more")]), path)
    got = sorted((r.workspace_id, r.text) for r in tables.read_messages(spark, path).collect())
    assert got == [("a", "one"), ("b", "more"), ("b", "new")]
    one = tables.person_timeline(tables.read_messages(spark, path), "b", "B")
    assert [r.text for r in one.collect()] == ["new", "more"]
    assert "PartitionFilters: [isnotnull(workspace_id" in one._jdf.queryExecution().toString()


def test_vector_table_upsert(spark, scratch):
    schema = "workspace_id string, message_id string, person_id string, embedding array<float>"
    old = spark.createDataFrame([("w", "1", "p", [1.0]), ("w", "2", "p", [2.0])], schema)
    new = spark.createDataFrame([("w", "2", "p", [9.0]), ("w", "3", "p", [3.0])], schema)
    merged = tables.upsert(old, new, ["message_id"])
    path = os.path.join(scratch, "vectors")
    tables.write_vectors(merged, path)
    got = {r.message_id: r.embedding for r in spark.read.parquet(path).collect()}
    assert got == {"1": [1.0], "2": [9.0], "3": [3.0]}


def test_partners(spark):
    people = spark.createDataFrame([("w", "A"), ("w", "B"), ("v", "A")], "workspace_id string, sender string")
    excluded = spark.createDataFrame([("w", "A")], "workspace_id string, sender string")
    assert {(r.workspace_id, r.sender) for r in tables.partners(people, excluded).collect()} == {("w", "B"), ("v", "A")}


def test_gate(chat):
    rows = [("w", "A", i, "hi there") for i in range(50)] + [("v", "A", i, "hi there") for i in range(49)]
    got = {r.workspace_id: r.eligible for r in ig.ingest_gate(chat(rows)).collect()}
    assert got == {"w": True, "v": False}


def test_clean_text_keeps_leading_blanks_only(spark):
    df = spark.createDataFrame([("﻿\n \na\n\n b  \nc <this message was EDITED> ",)], "t string")
    assert df.select(ig.clean_text(F.col("t"))).first()[0] == "\n\na\n b\nc"


def test_equal_file_names_of_two_folders_are_told_apart(spark, scratch):
    for folder in ("a", "b+1"):
        (Path(scratch) / folder).mkdir()
        (Path(scratch) / folder / "chat.txt").write_text(f"01/02/2024, 10:00 - A: {folder}\n")
    paths = [f"{scratch}/a", f"{scratch}/b+1"]
    whole = exports.explode_lines(exports.read_exports(spark, paths, folders=1)).filter("line <> ''")
    split = exports.read_export_lines(spark, paths, folders=1).filter("line <> ''")
    want = {("a/chat", "01/02/2024, 10:00 - A: a"), ("b+1/chat", "01/02/2024, 10:00 - A: b+1")}
    assert {(r.workspace_id, r.line) for r in whole.collect()} == {(r.workspace_id, r.line) for r in split.collect()} == want
