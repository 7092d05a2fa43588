"""The second look at tickets that may repeat an earlier one: what the client wrote then and now, judged by a callable, and written back.

The callable is given: a model's client, or a rule. It gets columns ``before`` and ``now`` and says for each row whether both are about
the same matter; anything else than a clear yes counts as no, and is final. Calls may cost money, so each happens once: ``Ledger`` asks in rounds,
writes what a round has decided before the next begins, keyed by client and opening time, and reports read what is written. A ticket folded
anew isn't asked about again. Calls keep their distance; one that fails ends the run, and what it hasn't decided stays pending.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import scratch_folder

FIRST, LONGEST, NOTHING, BUDGET = 3, 600, "(текст недоступен)", 60  # fixed values: messages and UTF-16 units of a side, its text if there is none, tickets of a run
ROUND = 20  # paced calls whose verdicts are written together

Judge = Callable[[pd.Series, pd.Series], pd.Series]
VERDICT = "client string, opened_at timestamp_ntz, verdict string"


def joined(texts: list[str]) -> str:
    """Texts on lines of their own, cut where they get longer than ``LONGEST``; the text that is cut follows without a line feed.

    Lengths are UTF-16 units; of a character that the cut falls into nothing stays.
    """
    out, size = "", 0
    for t in texts:
        units = t.encode("utf-16-le", "surrogatepass")
        if size + len(units) // 2 > LONGEST:
            return (out + units[: 2 * max(0, LONGEST - size)].decode("utf-16-le", "ignore")) or NOTHING
        out, size = out + ("\n" if size else "") + t, size + (1 if size else 0) + len(units) // 2
    return out or NOTHING


def first_texts(spans: DataFrame, messages: DataFrame) -> DataFrame:
    """id, side, text: the first messages that a client wrote within a span; spans: id, side, client, start, end (null: open).

    Spans and messages of a client pass by in order of time. A span takes the next messages until it has enough or is over, so that each message
    meets the few spans that still take some, however many there are of either.
    """
    said = messages.where("direction = 'in'").join(spans.select("client").distinct(), "client", "left_semi")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    marks = spans.select("client", at("start").alias("at"), F.lit(None).cast("long").alias("nth"), "id", "side", F.coalesce(at("end"), F.lit((1 << 63) - 1)).alias("until"))
    rows = marks.unionByName(said.select("client", at("created_at").alias("at"), F.col("source_id").alias("nth"), "txt"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, takes = None, []  # [id, side, until, texts] of spans that take more

        def made(done: list) -> pa.RecordBatch:
            ids, sides, _, texts = zip(*done, strict=True) if done else ((), (), (), ())
            return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "side": pa.array(sides, pa.string()), "text": pa.array(map(joined, texts), pa.string())})

        for b in batches:
            done = []
            for who, when, key, side, until, txt in zip(*(b.column(c).to_pylist() for c in ("client", "at", "id", "side", "until", "txt")), strict=True):
                if who != client:
                    done, takes, client = done + takes, [], who
                if key is not None:
                    takes.append([key, side, until, []])
                    continue
                for span in takes:
                    if when <= span[2]:
                        span[3].append(txt)
                over = [s for s in takes if when > s[2] or len(s[3]) == FIRST]
                if over:
                    done, takes = done + over, [s for s in takes if when <= s[2] and len(s[3]) < FIRST]
            yield made(done)
        yield made(takes)

    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "client").sortWithinPartitions("client", "at", F.col("nth").asc_nulls_first())
    return dealt.mapInArrow(run, "id long, side string, text string")


def candidates(tickets: DataFrame, messages: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, client, opened_at, before, now: texts of the ticket continued, and of every ticket that links to it, or of those ``asked`` for by id."""
    old = tickets.select(F.col("id").alias("p"), F.col("opened_at").alias("start"), F.coalesce("closed_at", "last_activity").alias("end"))
    linked = tickets.where("reopened_from IS NOT NULL").select("id", "client", "opened_at", "reopened_from")
    if asked is not None:
        linked = linked.join(asked.select("id"), "id", "left_semi")
    pairs = linked.join(old, F.col("reopened_from") == F.col("p")).select("id", "client", "opened_at", "start", "end")
    never = F.lit(None).cast("timestamp_ntz").alias("end")
    before = pairs.select("id", F.lit("before").alias("side"), "client", "start", "end")
    texts = first_texts(before.unionByName(pairs.select("id", F.lit("now").alias("side"), "client", F.col("opened_at").alias("start"), never)), messages)
    sides = texts.groupBy("id").agg(*(F.max(F.when(F.col("side") == side, F.col("text"))).alias(side) for side in ("before", "now")))
    return pairs.select("id", "client", "opened_at").join(sides, "id")


class Ledger:
    """Verdicts in a folder: asked for once, and read by whoever needs them."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self.tasks = spark, uri.rstrip("/"), int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def known(self) -> DataFrame:
        return self.spark.read.schema(VERDICT).parquet(self.uri).dropDuplicates(["client", "opened_at"])

    def keep(self, verdicts: DataFrame) -> None:
        verdicts.select("client", "opened_at", "verdict").write.mode("append").parquet(self.uri)

    def ask(self, tickets: DataFrame, messages: DataFrame, judge: Judge, budget: int | None = BUDGET, per_minute: float | None = None) -> int:
        """Judge up to ``budget`` pending tickets without a verdict, the least ids first, and return how many were decided.

        With ``per_minute`` one task calls at a time, in rounds of ``ROUND``. An executor that is lost makes no more than a round's calls happen again.
        """
        decided, left = 0, budget
        while left is None or left > 0:
            pending = tickets.where("reopen_llm = 'pending'").join(self.known(), ["client", "opened_at"], "left_anti")
            size = min(x for x in (left, ROUND) if x is not None) if per_minute else left
            if size is not None:
                pending = pending.orderBy("id").limit(size)
            before = self.known().count()
            asked = candidates(tickets, messages, pending).select("client", "opened_at", "before", "now")
            # the texts are few bytes but each is a call: all tasks take a share, not the few that bytes would fill
            dealt = asked.coalesce(1) if per_minute else asked.repartition(self.tasks, "client", "opened_at")
            self.keep(dealt.mapInPandas(_asking(judge, per_minute), VERDICT))
            got = self.known().count() - before
            decided, left = decided + got, None if left is None else left - size
            if not per_minute or got < size:
                break  # all were asked, or one failed
        return decided


def _asking(judge: Judge, per_minute: float | None):
    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0
        for part in parts:
            said, failed, before, now = [], False, part["before"], part["now"]
            for i in range(len(part)):
                if per_minute:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + 60.0 / per_minute
                try:
                    said.append(judge(before.iloc[i : i + 1], now.iloc[i : i + 1]).iloc[0])
                except Exception:  # whatever the callable raises: the rest stays pending, and what was decided is written
                    failed = True
                    break
            same = pd.Series(said, dtype="string").str.upper().str.contains("SAME").fillna(False).astype(bool)
            yield part[["client", "opened_at"]].iloc[: len(said)].assign(verdict=np.where(same, "same", "new"))
            if failed:
                return

    return ask


def judged(tickets: DataFrame, messages: DataFrame, judge: Judge, known: DataFrame | None = None, budget: int | None = BUDGET) -> DataFrame:
    """client, opened_at, verdict: ``known`` ones and those of up to ``budget`` pending tickets without one, asked for now, in a ledger of their own."""
    ledger = Ledger(tickets.sparkSession, scratch_folder(tickets.sparkSession, "verdicts"))
    if known is not None:
        ledger.keep(known)
    ledger.ask(tickets, messages, judge, budget)
    return ledger.known()


def written_back(tickets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tickets with the verdicts on those that wait for one; the others as they were."""
    said = verdicts.select("client", "opened_at", F.col("verdict").alias("__verdict"))
    joined_ = tickets.join(said, ["client", "opened_at"], "left")
    return joined_.withColumn(
        "reopen_llm",
        F.when(F.col("reopen_llm") == "pending", F.coalesce("__verdict", "reopen_llm")).otherwise(F.col("reopen_llm"))
    ).select(tickets.columns)
