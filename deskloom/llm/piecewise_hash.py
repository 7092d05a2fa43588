"""Document fingerprints by context-triggered piecewise hashing.

A hash over a rolling window of seven bytes decides where chunks end: where its low bits are all ones at the
document's block size. Each chunk gives one symbol, so that an edit changes the symbols of the chunks it touches
and no others. A fingerprint is ``block:signature:signature at the double block``; at most 64 symbols each, the
last one covering all that is left. Fingerprints compare where they share a block size, by insert/delete edit
distance, and only if the signatures have a run of four symbols in common.

Nulls: a null text is an empty one, with the fingerprint ``4::``. Equal texts have equal fingerprints, likeness 1.
An empty table gives no row; a table of one row is its own next row. Rows with equal keys are ordered by text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MOST, LEAST, WINDOW, RUN = 64, 4, 7, 4
_NUMBER = np.full(256, 64, np.int64)
_NUMBER[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(64)


def _rolled(raw: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at each byte."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), raw.astype(np.uint32)])
    n = len(raw)
    h = padded[:n].copy()
    for j in range(1, WINDOW):
        h *= np.uint32(0x01000193)
        h += padded[j : j + n]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(8)


def _signature(data: bytes, ends: np.ndarray) -> str:
    out, at, crc = [], 0, zlib.crc32
    for e in [*ends[: MOST - 1].tolist(), len(data)]:
        if e > at:
            h = crc(data[at:e])
            out.append(SYMBOLS[(h ^ h >> 7 ^ h >> 17) & 63])
            at = e
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    block = LEAST
    if not data:
        return f"{block}::"
    while block * MOST < len(data):
        block *= 2
    h = _rolled(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero((h & np.uint32(block - 1)) == block - 1)
    while len(ends) < MOST // 2 and block > LEAST:
        block //= 2
        ends = np.flatnonzero((h & np.uint32(block - 1)) == block - 1)
    wide = ends[(h[ends] & np.uint32(2 * block - 1)) == 2 * block - 1]
    return f"{block}:{_signature(data, ends + 1)}:{_signature(data, wide + 1)}"


def _symbols(signatures: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(s.ljust(MOST, ".") for s in signatures).encode(), np.uint8)
    return _NUMBER[raw].reshape(len(signatures), MOST)


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, bit-parallel over all pairs at once."""
    n, one = len(a), np.uint64(1)
    at = np.arange(n)
    left, right = _symbols(a), _symbols(b)
    where = np.zeros((n, 65), np.uint64)
    for j in range(MOST):
        where[at, left[:, j]] |= one << np.uint64(j)
    where[:, 64] = 0  # padding matches nothing
    v = np.full(n, ~np.uint64(0))
    for j in range(MOST):
        u = v & where[at, right[:, j]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _shares_run(a: str, b: str) -> bool:
    k = min(RUN, len(a), len(b))
    return k > 0 and any(a[i : i + k] in b for i in range(len(a) - k + 1))


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: the best of the signatures that have a block size in common."""
    out = np.zeros(len(a))
    row, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (p, s1, s2), (q, t1, t2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        pairs = [(s1, t1), (s2, t2)] if p == q else [(s1, t2)] if p == 2 * q else [(s2, t1)] if 2 * p == q else []
        for s, t in pairs:
            if _shares_run(s, t):
                row.append(i)
                left.append(s)
                right.append(t)
    if row:
        size = np.asarray([len(s) + len(t) for s, t in zip(left, right, strict=True)])
        np.maximum.at(out, np.asarray(row), 2 * _common(left, right) / size)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "fingerprint": [fingerprint(t) for t in b.column("text").to_pylist()]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key long, fingerprint string")


def with_tail(text: str, other: str) -> str:
    """``text`` with its last third replaced by as many characters from the start of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


ROW = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple], others: list[tuple]) -> dict:
    """rows, others: (key, text, fingerprint)."""
    edited = [with_tail(t, u) for (_, t, _), (_, u, _) in zip(rows, others, strict=True)]
    own, prints = [r[2] for r in rows], [fingerprint(t) for t in edited]
    return {
        "key": pa.array([r[0] for r in rows], pa.int64()), "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited], "fingerprint": own, "edited_fingerprint": prints,
        "near_edited": likeness(own, prints), "near_next": likeness(own, [o[2] for o in others]),
    }


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row against the next one in descending key order (after the last: the first) and against its edit by it.

    Rows are range-partitioned and sorted; a task keeps one row back until it has read the next. The first and
    last rows of each task go to the shared folder and meet their neighbours there, one pair for each task.
    """
    order = [F.col("key").desc_nulls_last(), F.col("text").desc()]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        at, last, first = TaskContext.get().partitionId(), None, None

        def batch(cols: dict, head: str | None = None, tail: str | None = None):
            n = len(cols["key"])
            return pa.RecordBatch.from_pydict({**cols, "task": pa.array([at] * n, pa.int32()), "head": pa.array([head] * n, pa.string()), "tail": pa.array([tail] * n, pa.string())})

        def edge(row: tuple, **which):
            blank = {"n_chars": pa.nulls(1, pa.int64()), "edited_sha256": pa.nulls(1, pa.string()), "edited_fingerprint": pa.nulls(1, pa.string()), "near_edited": pa.nulls(1, pa.float64()), "near_next": pa.nulls(1, pa.float64())}
            return batch({"key": pa.array([row[0]], pa.int64()), "fingerprint": [row[2]], **blank}, **which).select([*names, "task", "head", "tail"])

        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                got = [(k, t, fingerprint(t)) for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True)]
                if first is None:
                    first = got[0]
                    yield edge(first, head=first[1])
                got = ([last] if last else []) + got
                last = got[-1]
                if len(got) > 1:
                    yield batch(_compared(got[:-1], got[1:]))
        if last:
            yield edge(last, tail=last[1])

    made = scratch.table(rows.mapInArrow(run, f"{ROW}, task int, head string, tail string"), "neighbours")
    done = made.where("head IS NULL AND tail IS NULL").select(names)
    heads = made.where("head IS NOT NULL").select("task", F.col("head").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = made.where("tail IS NOT NULL").select("task", "key", "tail", "fingerprint")
    # one row for each task: the task after it, the last one's being the first
    every = heads.select("task").withColumn("after", F.lead("task").over(Window.orderBy("task")))
    every = every.withColumn("after", F.coalesce("after", F.min("task").over(Window.partitionBy())))
    ends = tails.join(every, "task").join(heads.withColumnRenamed("task", "after"), "after").select("key", "tail", "fingerprint", "next_text", "next_print")

    def close(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pydict(_compared([(r["key"], r["tail"], r["fingerprint"])], [(None, r["next_text"], r["next_print"])]))

    return done.unionByName(ends.mapInArrow(close, ROW))
