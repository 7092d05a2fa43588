"""Windows over message times: bursts, first messages of days, runs of one sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GAP_MINUTES, RUN_MINUTES = 30, 5


def _minutes(a: Column, b: Column) -> Column:
    """Whole minutes from a to b."""
    return F.floor((F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))) / 60)


def bursts(rows: DataFrame, key: str = "client", at: str = "at", gap: int = GAP_MINUTES) -> DataFrame:
    """The rows that start a run of times: the first of a key, and those after a quiet gap of ``gap`` minutes or more."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("__before", before).where(
        F.col("__before").isNull() | (_minutes(F.col("__before"), F.col(at)) >= gap)
    ).drop("__before")


def conversation_days(messages: DataFrame) -> DataFrame:
    """client, day, at: the first message of each day, by an aggregate that combines before the shuffle."""
    return messages.groupBy("client", F.to_date("created_at").alias("day")).agg(F.min("created_at").alias("at"))


def message_runs(messages: DataFrame, gap: int = RUN_MINUTES) -> DataFrame:
    """Messages with ``continued``: same client, day, direction and sender as the one before, less than ``gap`` minutes later."""
    w = Window.partitionBy("client", F.to_date("created_at")).orderBy("created_at", "source_id")
    same = (F.lag("direction").over(w) == F.col("direction")) & (F.lag("author").over(w) == F.col("author"))
    near = _minutes(F.lag("created_at").over(w), F.col("created_at")) < gap
    return messages.withColumn("continued", F.coalesce(same & near, F.lit(False)))
