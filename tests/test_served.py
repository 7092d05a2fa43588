import os
import subprocess
import sys
from datetime import datetime

import pytest

from deskloom.plans import catalog, metrics as M
from deskloom.sources import archive as A
from deskloom.sources.adapter import desk
from deskloom.sources.store import Store
from deskloom.streaming import ingest as I
from deskloom.streaming.served import Served, stored_desk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """An archive of January and the same conversations in March, in two batches."""
    d, made = desk(spark, SF), Store(spark, f"file://{tmp_path_factory.mktemp('served')}", keep=99)
    rows = A.archived(d.message)
    later = rows.selectExpr("id + 100000000 AS id", "username", "peer", "bare_peer", "txt", "created_at + INTERVAL 60 DAYS AS created_at", "timestamp + 5184000000000 AS timestamp", "CAST(NULL AS BINARY) AS xml")
    I.ingest(made, rows, {"client_group": d.member})
    made.first = made.state()
    I.ingest(made, later)
    return made


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_reports_over_an_ingested_archive_equal_those_over_events(spark, store):
    d, p, s = desk(spark, SF), catalog.PERIOD, catalog.ALL
    pinned = stored_desk(store, store.first, p)
    for report in (M.timeseries, M.summary, M.sla, M.reopens, M.clients):
        assert same(report(pinned, p, s), report(d, p, s)), report.__name__
    assert pinned.horizon == d.horizon


def test_only_the_periods_months_are_read(spark, store):
    march = M.Period(datetime(2024, 3, 4), datetime(2024, 3, 20))
    got = stored_desk(store, None, march).message
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-03" in plan
    assert {r[0] for r in got.selectExpr("date_format(created_at, 'yyyy-MM')").distinct().collect()} == {"2024-03"}


def test_a_commit_gives_a_new_desk_and_leaves_the_old_one(spark, store):
    served, p = Served(store), catalog.PERIOD
    before = served.desk(p)
    n = before.ticket.count()
    assert served.desk(p) is before
    extra = spark.createDataFrame(
        [(900_000_000, "u1", "help@desk", "help@desk", "почта", datetime(2024, 6, 3, 10), 1_717_400_000_000_000, None)],
        "id long, username string, peer string, bare_peer string, txt string, created_at timestamp_ntz, timestamp long, xml binary",
    )
    I.ingest(store, extra)
    after = served.desk(p)
    assert after is not before and after.ticket.count() == n + 1 and after.horizon == datetime(2024, 6, 3, 10, 0, 1)
    assert before.ticket.count() == n and stored_desk(store, store.first).horizon < before.horizon < after.horizon


def test_ranges_of_ids_hold_about_as_many_rows_each():
    counts = [(0, 1000)] + [(b, 10) for b in range(500, 600)]
    ranges = A.id_ranges(counts, 100, 4)
    rows = [sum(n for b, n in counts if s <= b * 100 < e) for s, e in ranges]
    assert sum(rows) == 2000 and len(rows) <= 4 and max(rows) <= 1000 and sorted(rows)[0] >= 100
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])) and A.id_ranges([], 5, 3) == []


def test_archive_over_jdbc(spark):
    url, driver = "jdbc:derby:memory:archive;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i, f"u{i % 3}", f"t{i}") for i in [*range(1, 60), *range(1_000_000, 1_000_040)] if i % 7]
    df = spark.createDataFrame(rows, "ID long, USERNAME string, TXT string")
    df.write.format("jdbc").options(url=url, dbtable="archive", driver=driver, createTableColumnTypes="USERNAME VARCHAR(20), TXT VARCHAR(20)").save()
    got = A.archive_rows(spark, url, above=5, to=1_000_030, tasks=4, driver=driver)
    assert sorted(r.ID for r in got.collect()) == [i for i, *_ in rows if 5 < i <= 1_000_030]
    assert 2 <= got.rdd.getNumPartitions() <= 4 and max(got.rdd.mapPartitions(lambda p: [len(list(p))]).collect()) < 60
    assert A.archive_rows(spark, url, above=2_000_000, driver=driver).count() == 0


def test_archive_over_jdbc_on_executors_of_their_own(tmp_path):
    """A database that one process writes is read by others: executors here are processes apart from the driver."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config(
    "spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from deskloom.sources import archive as A, embedded as E
rows = spark.range(1, 900).selectExpr("id", "concat('u', id % 3) AS username", "CASE WHEN id % 5 > 0 THEN concat('a,', chr(34), chr(10), id) END AS txt")
urls = E.databases(rows, "file://{tmp_path}/db", "ID BIGINT, USERNAME VARCHAR(20), TXT VARCHAR(20)", shard_rows=300)
assert len(urls) == 3 and all(u.startswith("jdbc:derby:jar:(") for u in urls)
got = [A.archive_rows(spark, u, above=40, tasks=2, driver=E.DRIVER) for u in urls]
read = sorted(tuple(r) for r in got[0].union(got[1]).union(got[2]).collect())
assert read == [(i, f"u{{i % 3}}", f'a,"' + chr(10) + str(i)) for i in range(41, 900) if i % 5], read[:9]
assert E.databases(rows.where("false"), "file://{tmp_path}/none", "ID BIGINT, USERNAME VARCHAR(20), TXT VARCHAR(20)") == []
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", code], env={k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-3000:]
