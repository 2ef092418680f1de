import random

import pytest

from layerlake.streaming import ingest


def batches(seconds, window):
    out, start = {}, None
    for s in sorted(seconds):
        if start is None or s >= start + window:
            start = s
        out[s] = start
    return out


@pytest.mark.parametrize("seed,window,steps", [(1, 30, (0, 1, 5, 29, 30, 31)), (2, 600, (1, 2, 3)), (3, 7, (1, 6, 7, 100_000))])
def test_windows_equal_a_scan(spark, seed, window, steps):
    r = random.Random(seed)
    at, times = 86_400 * 3 - 200, []
    for _ in range(1500):
        at += r.choice(steps)
        times.append(at)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(9999, None)], "id long, t long").selectExpr("id", "timestamp_seconds(t) as ts").repartition(4)
    got = {(x.id, x.batch) for x in ingest.claim_batches(df, "ts", window).selectExpr("id", "unix_seconds(batch) as batch").collect()}
    want = batches(times, window)
    assert got == {(i, want[t]) for i, t in enumerate(times)}


def test_over_midnight_and_empty(spark):
    df = spark.createDataFrame([("2024-01-01 23:59:50",), ("2024-01-02 00:00:10",), ("2024-01-02 00:00:20",)], "ts string").selectExpr("cast(ts as timestamp) as ts")
    got = sorted(str(x.batch)[11:] for x in ingest.claim_batches(df, "ts", 30).selectExpr("cast(batch as string) as batch").collect())
    assert got == ["00:00:20", "23:59:50", "23:59:50"]
    assert ingest.claim_batches(df.limit(0), "ts", 30).collect() == []
