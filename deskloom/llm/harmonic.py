"""Harmonic packing of token sequences into bins of one capacity.

A piece belongs to class k when its length is in (capacity/(k+1), capacity/k]; a bin of class k holds exactly k
pieces. A piece that would leave its bins emptier than ``slack`` is first cut: capacity/(k+1) ids go to class k+1,
whose bins they fill, and the rest is classed anew. Classes are so narrow that a bin's padding is at most ``slack``.

Workers number the pieces of each class on their own; only the counts of (worker, class) meet, and give each
worker the first number of each of its classes. A class leaves at most k-1 pieces over, too few for a bin; those of all classes are repacked
together by first fit, largest piece first. That is one task whatever the input's size: below one bin's ids for each class that ``cuts`` can give,
so fewer than capacity^2/2 pieces, and in practice some hundreds of bins (classes of very short pieces are rare).

Nulls: a null text is an empty one, and gives one piece with the end id alone. Rows with equal ids stay separate
documents. An empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch
from .chunk_bpe import encoder


def cuts(length: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document, in order."""
    out = [(capacity, 1)] * (length // capacity)
    r = length % capacity
    while r:
        k = capacity // r
        if capacity - k * r <= slack:
            out.append((r, k))
            break
        n = capacity // (k + 1)
        out.append((n, k + 1))
        r -= n
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, slack: int, key: str, text: str) -> DataFrame:
    """One row for each piece: where it lies in its document, its class, its worker and its number there."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def cut(batches):
        from pyspark import TaskContext

        at, enc, made, known = TaskContext.get().partitionId(), encoder(vocabulary), {}, {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                flat, n = enc.encode(b.column("text").slice(i, 500).to_pylist())
                key, stop, out = b.column("key").slice(i, 500).to_pylist(), np.cumsum(n), []
                for j, (doc, m, to) in enumerate(zip(key, n.tolist(), stop.tolist(), strict=True)):
                    ids = np.append(flat[to - m : to], enc.dtype.type(end_id)).astype("<u4").tobytes()
                    start = 0
                    if m + 1 not in known:
                        known[m + 1] = cuts(m + 1, capacity, slack)
                    for size, k in known[m + 1]:
                        made[k] = nth = made.get(k, -1) + 1
                        out.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), m + 1, k, at, nth))
                        start += size
                if len(known) > 100_000:
                    known.clear()
                names = ("key", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "nth")
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out, strict=True), strict=True)})

    return rows.mapInArrow(cut, "key long, start long, length long, ids_crc32 long, doc_tokens long, class long, task long, nth long")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, slack: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its class."""
    cut = scratch.table(pieces(docs, vocabulary, end_id, capacity, slack, key, text), "pieces")
    by_class = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("class", "task").count()
    based = counts.withColumn("before", F.coalesce(F.sum("count").over(by_class), F.lit(0)))
    totals = [(r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("count").alias("n")).orderBy("class").collect()]  # capacity rows at most
    full, base = [], 0
    for k, n in totals:
        full.append((k, n - n % k, base))
        base += n // k
    classes = cut.sparkSession.createDataFrame(full, "class long, placed long, base long")
    numbered = cut.join(based.drop("count"), ["class", "task"]).join(F.broadcast(classes), "class").withColumn("nth", F.col("nth") + F.col("before"))
    whole = numbered.where("nth < placed").withColumn("sequence_id", F.expr("base + nth div class"))
    rest = numbered.where("nth >= placed").withColumn("one", F.lit(0))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "class", "nth"], ascending=[False, True, True], ignore_index=True)
        left, where = np.empty(0, np.int64), np.empty(len(pdf), np.int64)
        for i, n in enumerate(pdf["length"].tolist()):
            open_ = np.flatnonzero(left >= n)
            if not len(open_):
                left, open_ = np.append(left, capacity), [len(left)]
            where[i] = open_[0]
            left[open_[0]] -= n
        return pdf.assign(sequence_id=base + where)

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "class", "nth", "sequence_id"]
    short = rest.groupBy("one").applyInPandas(lambda pdf: fit(pdf)[names], ", ".join(f"`{c}` long" for c in names))
    within = Window.partitionBy("sequence_id").orderBy("class", "nth").rowsBetween(Window.unboundedPreceding, -1)
    both = whole.select(names).unionByName(short)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("nth")
