"""The block-cut scans against plain Python on random data, with blocks far smaller than parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkweave.plans import ordered as od


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for ws, n in (("hot", 700), ("a", 40), ("b", 1)):
        seq = 0
        for _ in range(n):
            seq += rng.randint(1, 9)
            # Half of the hot rows share one instant.
            ts = 100 if rng.random() < 0.5 else rng.randint(0, 400)
            data.append((ws, seq, ts, rng.randint(0, 5)))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "ws string, seq bigint, t bigint, v bigint")
    return data, df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(t as int), 0, 0)"))


def test_dense_position_by_seq_and_time(rows):
    data, df = rows
    by_seq = od.dense_position(df, ["ws"], [F.col("seq")], od.seq_levels("seq", 16), total="n")
    by_time = od.dense_position(df, ["ws"], [F.col("ts"), F.col("seq")], od.time_levels("ts", "seq", 16))
    for result, key in ((by_seq, lambda r: r[1]), (by_time, lambda r: (r[2], r[1]))):
        got = {(r.ws, r.seq): r.pos for r in result.collect()}
        for ws in ("hot", "a", "b"):
            ordered = sorted((r for r in data if r[0] == ws), key=key)
            assert [got[(ws, r[1])] for r in ordered] == list(range(len(ordered)))
    assert {(r.ws, r.n) for r in by_seq.select("ws", "n").distinct().collect()} == {("hot", 700), ("a", 40), ("b", 1)}


def test_running_before(rows):
    data, df = rows
    blocked = df.withColumn("_blk", od.block_of("seq", 32))
    out = od.running_before(
        blocked, ["ws"], "_blk", [F.col("seq")], {"total": ("sum", F.col("v")), "peak": ("max", F.col("t"))}
    )
    got = {(r.ws, r.seq): (r.total, r.peak) for r in out.collect()}
    for ws in ("hot", "a", "b"):
        total, peak = 0, None
        for r in sorted((r for r in data if r[0] == ws), key=lambda r: r[1]):
            assert got[(ws, r[1])] == (total, peak)
            total, peak = total + r[3], r[2] if peak is None else max(peak, r[2])


def test_neighbours_give_whole_frames(rows):
    _, df = rows
    dense = od.dense_position(df, ["ws"], [F.col("seq")], od.seq_levels("seq", 16))
    near = od.with_neighbours(dense, "pos", 3, 4, 8)
    w = Window.partitionBy("ws", "_blk").orderBy("pos").rowsBetween(-3, 4)
    cut = near.withColumn("f", F.collect_list("pos").over(w)).filter("_own")
    got = {(r.ws, r.pos): r.f for r in cut.collect()}
    sizes = {"hot": 700, "a": 40, "b": 1}
    assert len(got) == sum(sizes.values())
    for (ws, pos), frame in got.items():
        assert frame == list(range(max(0, pos - 3), min(sizes[ws], pos + 5)))


def test_frame_must_fit_block(rows):
    with pytest.raises(ValueError):
        od.with_neighbours(rows[1], "seq", 8, 0, 8)


@pytest.mark.parametrize("n", [1, 2, 5, 7, 20, 41])
@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 19])
def test_keep_evenly(spark, n, k):
    kept = [
        r.id
        for r in spark.range(n).filter(od.keep_evenly(F.col("id"), F.lit(n), F.lit(k))).collect()
    ]
    if k <= 0:
        want = []
    elif n <= k:
        want = list(range(n))
    elif k == 1:
        want = [n // 2]
    else:
        step = max((n - 1) // (k - 1), 1)
        want = sorted(set(range(0, n, step)) | {n - 1})[:k]
    assert sorted(kept) == want
