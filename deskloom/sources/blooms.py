"""Bloom filters of the keys that a part of a table holds, so that parts without a key that is asked for aren't read.

A filter covers at most ``SLICE_ROWS`` keys: larger parts are cut into slices by the key's hash, each with a filter of its own.
Filters meet the keys asked for by slice, in tasks; what comes back is which slices of which parts may hold one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS, HASHES, SLICE_ROWS = 40, 16, 1 << 20  # bits for each key; one in some 50 million keys is taken for one that is there
AT_ONCE = 1 << 15  # keys whose bits are numbered at once: they take 128 bytes a key, and some for what they come from


def key_hash(key: str) -> Column:
    return F.xxhash64(key)


def slice_of(h: Column, slices: int | Column) -> Column:
    return F.pmod(h, F.lit(slices) if isinstance(slices, int) else slices).cast("int")


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bit numbers, one for each key; ``bits`` is a power of two."""
    a = h.astype(np.uint64)
    b = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)
    return ((a[:, None] + i * (b[:, None] >> np.uint64(7) | np.uint64(1))) ^ (b[:, None] >> (i + np.uint64(20)))) & np.uint64(bits - 1)


def made(h: np.ndarray) -> bytes:
    bits = 1 << max(10, int(BITS * max(1, len(h)) - 1).bit_length())
    held = np.zeros(bits, bool)
    for i in range(0, len(h), AT_ONCE):
        held[_places(h[i : i + AT_ONCE], bits).ravel()] = True
    return np.packbits(held, bitorder="little").tobytes()


def holds(filter_bits: bytes, h: np.ndarray) -> np.ndarray:
    """Which of the keys may be among those the filter was made of; those that were are."""
    return np.concatenate([np.empty(0, bool), *_held(filter_bits, h)])


def _held(filter_bits: bytes, h: np.ndarray) -> Iterator[np.ndarray]:
    held = np.frombuffer(filter_bits, np.uint8)
    for i in range(0, len(h), AT_ONCE):
        at = _places(h[i : i + AT_ONCE], 8 * len(held))
        yield ((held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def filters(rows: DataFrame, slices: int) -> DataFrame:
    """slices, slice, bits: a filter for each slice of (slice, h)."""

    def make(table: pa.Table) -> pa.Table:
        return pa.table({"slices": pa.array([slices], pa.int32()), "slice": [table["slice"][0].as_py()], "bits": [made(table["h"].to_numpy())]}, _FILTER)

    return rows.groupBy("slice").applyInArrow(make, "slices int, slice int, bits binary")


_FILTER = pa.schema([("slices", pa.int32()), ("slice", pa.int32()), ("bits", pa.binary())])


def hits(known: DataFrame, keys: DataFrame, slices: list[int]) -> list[tuple[str, int]]:
    """(part, slice) whose filter holds a key; known: part, slices, slice, bits; keys: h; slices: the numbers of slices that parts have."""

    def ask(mine: pa.Table, asked: pa.Table) -> pa.Table:
        h = asked["h"].to_numpy()
        found = [any(some.any() for some in _held(bits.as_py(), h)) for bits in mine["bits"]]
        return mine.select(["part", "slice"]).filter(pa.array(found, pa.bool_()))

    n = keys.count()
    shares = {k: -(-n // (k * SLICE_ROWS)) or 1 for k in slices}  # a part of few slices may be asked for many keys: its filters meet them in shares
    of = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("slices")]
    asked = keys.select("h", F.explode(F.array(*map(F.lit, slices))).alias("slices")).withColumn("slice", slice_of(F.col("h"), F.col("slices")))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("h"), of)).distinct()
    dealt = known.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1)))
    by = ["slices", "slice", "share"]
    met = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(ask, "part string, slice int")
    return sorted(tuple(r) for r in met.distinct().collect())  # at most one row for each slice of each part
