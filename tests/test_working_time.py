from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from deskloom.functions import working_time as W

T = lambda d, h, m=0, s=0: datetime(2026, 7, d, h, m, s)  # noqa: E731  Monday is the 6th


def slow(a, b):
    """Second by second over whole minutes."""
    n, t = 0, a
    while t < b:
        if t.weekday() < 5 and 8 <= t.hour < 18:
            n += min(60, int((b - t).total_seconds()))
        t += timedelta(minutes=1)
    return n


def between(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz")
    return [r[1] for r in df.select("i", W.seconds_between(F.col("a"), F.col("b"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "a,b,want",
    [(T(6, 9), T(6, 10), 3600), (T(6, 17, 30), T(7, 8, 30), 3600), (T(10, 17), T(13, 9), 7200), (T(11, 9), T(12, 20), 0), (T(6, 6), T(6, 20), 36000), (T(6, 10), T(6, 9), 0), (T(6, 9), T(6, 9), 0), (T(6, 9), T(13, 9), 180000)],
)
def test_between(spark, a, b, want):
    assert between(spark, [(a, b)]) == [want]


def test_nulls_and_brute_force(spark):
    import random

    r = random.Random(1)
    pairs = [(a := datetime(2026, 7, 1) + timedelta(minutes=r.randrange(20_000)), a + timedelta(minutes=r.randrange(9_000))) for _ in range(40)]
    assert between(spark, pairs) == [slow(*p) for p in pairs]
    assert between(spark, [(None, T(6, 9)), (T(6, 9), None)]) == [0, 0]


def test_plus_is_the_inverse(spark):
    starts = [T(6, 8), T(6, 12, 30), T(6, 17, 59), T(10, 17), T(11, 3), T(12, 23), T(7, 6)]
    rows = [(i * 10 + j, t, n) for i, t in enumerate(starts) for j, n in enumerate([0, 1, 600, 3600, 36000, 72000, 144000, 180001])]
    df = spark.createDataFrame(rows, "i int, t timestamp_ntz, n long").withColumn("u", W.at_index(W.index(F.col("t")) + F.col("n")))
    got = df.select("n", "u", (W.index(F.col("u")) - W.index(F.col("t"))).alias("d")).collect()
    assert all(r.d == r.n and r.u.weekday() < 5 and 8 <= r.u.hour < 18 for r in got)


def test_buckets(spark):
    df = spark.createDataFrame([(T(12, 23, 59),)], "t timestamp_ntz")
    r = df.select(*(W.bucket(F.col("t"), u).cast("string").alias(u) for u in ("day", "week", "month", "other")), W.next_working_day(F.col("t")).alias("n")).first()
    assert tuple(r)[:4] == ("2026-07-12", "2026-07-06", "2026-07-01", "2026-07-12") and r.n == T(13, 23, 59)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.datetimes(datetime(2000, 1, 3), datetime(2030, 1, 1)), min_size=1, max_size=8))
def test_index_never_falls(spark, times):
    times = sorted(t.replace(microsecond=0) for t in times)
    got = [r[1] for r in spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz").select("i", W.index(F.col("t"))).orderBy("i").collect()]
    assert got == sorted(got)
