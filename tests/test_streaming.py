import os
import random

from pyspark.sql import functions as F

from talkweave.operators import turns as tn
from talkweave.sources.tables import read_messages
from talkweave.streaming import activity, ingest, replies


def staged(spark, df, folder, batches):
    """One parquet file per batch of consecutive lines, older files first."""
    size = (df.agg(F.max("seq")).first()[0] + 1) / batches
    for i in range(batches):
        part = df.filter(F.floor(F.col("seq") / size) == i).coalesce(1)
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_memory(stream, name, scratch, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", os.path.join(scratch, name)
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def talk(chat):
    rng = random.Random(8)
    rows = []
    for ws in ("a", "b"):
        minute = 0
        for _ in range(90):
            minute += rng.choice([0, 1, 10, 31, 90, 300])
            rows.append((ws, rng.choice("AB"), minute, "hi there"))
    return chat(rows)


def test_reply_events_equal_batch(spark, chat, scratch):
    df = talk(chat)
    stream = staged(spark, df, os.path.join(scratch, "in"), 4)
    out = os.path.join(scratch, "out")
    replies.stream_reply_events(stream, os.path.join(scratch, "state"), out, os.path.join(scratch, "cp"), 8).awaitTermination()
    columns = ["workspace_id", "first_seq", "sender", "previous_sender", "gap_seconds", "kind"]
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() > 1
    want = tn.turn_events(tn.turns(df, 8), 8)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_windows_equal_batch(spark, chat, scratch):
    df = talk(chat)
    stream = staged(spark, df, os.path.join(scratch, "in"), 3)
    for name, build in (("hours", activity.hourly_counts), ("weeks", activity.weekly_counts), ("slides", activity.sliding_counts), ("sessions", activity.session_counts)):
        run_to_memory(build(stream, lateness="400 days"), name, scratch, "complete")
        key = ["workspace_id", "start", "end", "message_count"]
        assert sorted(map(tuple, spark.table(name).select(key).collect())) == sorted(map(tuple, build(df).select(key).collect()))
    monday = spark.table("weeks").select(F.weekday("start").alias("d"), F.hour("start").alias("h")).distinct().collect()
    assert [(r.d, r.h) for r in monday] == [(0, 0)]


def test_sessions_close_at_the_gap(spark, chat):
    df = chat([("w", "A", 0, "a"), ("w", "A", 29, "b"), ("w", "A", 59, "c"), ("w", "B", 90, "d")])
    got = [r.message_count for r in activity.session_counts(df).orderBy("start").collect()]
    assert got == [3, 1]


def test_export_stream_is_incremental(spark, scratch):
    folder, table, cp = (os.path.join(scratch, x) for x in ("in", "messages", "cp"))
    os.makedirs(folder)

    def put(name, text):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)

    put("one.txt", "01/02/2024, 10:00 - A: hi\n01/02/2024, 10:01 - B: ho\n")
    ingest.ingest_exports(spark, folder, table, cp).awaitTermination()
    put("two.txt", "01/02/2024, 10:00 - C: hey\n77/77/2024, 10:01 - C: bad\n")
    ingest.ingest_exports(spark, folder, table, cp).awaitTermination()
    got = sorted((r.workspace_id, r.sender, r.text) for r in read_messages(spark, table).collect())
    assert got == [("one", "A", "hi"), ("one", "B", "ho"), ("two", "C", "hey")]
    assert [r.raw for r in spark.read.parquet(table + "_rejects").collect()] == ["77/77/2024, 10:01 - C: bad"]
