"""Figures that the dashboard derives from reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scope import Scope
from ..sources.adapter import Desk
from ..sources.store import scratch_folder
from . import metrics as M

OTHER, POOLED, TREND_TOP = "Другое", "Прочие", 6  # fixed values


def overall_frt(desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    """Means over buckets weighted by responses; the second one is of medians, a proxy."""
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("responses")) / F.sum("responses"), 4)
    return M.sla(desk, p, scope).agg(weighted("avg_seconds").alias("mean_seconds"), weighted("p50_seconds").alias("typical_seconds"))


def totals(desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    return M.timeseries(desk, p, scope).agg(
        *(M.total(c).alias(c) for c in ("messages", "closed", "rejected")),
        F.round(F.avg("messages")).cast("long").alias("per_bucket")
    )


def share(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; null on nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5).cast("long"))


def reopen_rate(desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    sums = M.reopens(desk, p, scope).agg(*(M.total(c).alias(c) for c in ("closed", "probable", "confirmed")))
    return sums.select(
        "*", share(F.col("probable"), F.col("closed")).alias("probable_pct"),
        share(F.col("confirmed"), F.col("closed")).alias("confirmed_pct")
    )


def classified(desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    named = M.total(F.when(F.col("category") != OTHER, F.col("requests")))
    return M.categories(desk, p, scope).agg(share(named, F.sum("requests")).alias("classified_pct"))


def heatmap_average(desk: Desk, p: M.Period, scope: Scope) -> DataFrame:
    """Messages of a weekday and hour by how often that weekday is in the period."""
    days = desk.spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(p.start)), F.date_sub(F.to_date(F.lit(p.end)), 1))).alias("d"))
    often = days.groupBy(F.weekday("d").alias("weekday")).agg(F.count("*").alias("days"))
    cells = M.heatmap(desk, p, scope).join(F.broadcast(often), "weekday")  # seven rows
    return cells.select("weekday", "hour", F.floor(F.col("messages") / F.col("days") + 0.5).cast("long").alias("messages"))


def category_trend(desk: Desk, p: M.Period, scope: Scope, top: int = TREND_TOP) -> DataFrame:
    """Requests by day of the largest named categories, the rest pooled, days without any filled with 0."""
    trend = M.category_timeseries(desk, p, scope)
    best = trend.where(F.col("category") != OTHER).groupBy("category").agg(F.sum("requests").alias("n")).orderBy(F.desc("n"), "category").limit(top).select(
        "category", F.lit(True).alias("top")
    )
    pooled = trend.join(F.broadcast(best), "category", "left").select(
        "bucket", F.when(F.col("top"), F.col("category")).otherwise(POOLED).alias("category"), "requests"
    )
    names = best.select("category").union(desk.spark.createDataFrame([(POOLED,)], "category string"))
    grid = trend.select("bucket").distinct().crossJoin(F.broadcast(names))  # days by seven names
    sums = pooled.groupBy("bucket", "category").agg(F.sum("requests").alias("requests"))
    return grid.join(sums, ["bucket", "category"], "left").fillna(0, ["requests"])


def by_number(name: Column) -> Column:
    """A sort key in which u2 comes before u10: runs of digits padded to one width."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(F.lower(x))), "")


def numbered_clients(desk: Desk) -> DataFrame:
    """Every client with its place: dealt by ranges of the key, numbered in each range, plus the rows of the ranges before.

    What is dealt is written once, as both the numbers and the sizes of ranges are read from it.
    """
    names = desk.member.select("client").distinct().withColumn("k", by_number(F.col("client")))
    tasks = int(desk.spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that ranges stay as they are dealt
    path = scratch_folder(desk.spark, "ranges")
    names.repartitionByRange(tasks, "k").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = desk.spark.read.schema("client string, k string, part int").parquet(path)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("rows"))  # one row for each range
    before = sizes.select(
        "part",
        F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    nth = F.row_number().over(Window.partitionBy("part").orderBy("k", "client"))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "part").select(
        "client", (F.col("before") + F.col("nth")).cast("int").alias("place")
    )


def humanized(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(s.cast("string"), F.lit(" с"))
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit(" мин "), two(s % 60), F.lit(" с"))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit(" ч "), two(F.floor(s % 3600 / 60)), F.lit(" мин"))
    return F.when(seconds.isNull(), "-").when(s < 60, short).when(s < 3600, minutes).otherwise(hours)
