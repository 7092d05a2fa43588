"""Vector columns as integer matrices, batch by batch, in tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LARGEST = float(1 << 20)  # entries beyond it have no integer form that sums of squares of some thousand dimensions hold


def usable(vector: str, largest: float = LARGEST) -> Column:
    """Whether a vector has entries, all of them finite and none beyond ``largest``."""
    good = lambda x: x.isNotNull() & F.coalesce(F.abs(x.cast("double")) <= largest, F.lit(False))  # noqa: E731  NaN counts as greater
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def usual_length(df: DataFrame, vector: str) -> tuple[int, int]:
    """The length that most vectors have, of several the longest, and how many have it; 0 without vectors."""
    top = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (top["n"], top["count"]) if top else (0, 0)


def matrix(column: pa.Array, scale: int, shift: int, dims: int) -> np.ndarray:
    """A row for each list, all of length ``dims``: floor(scale * entry) + shift, the entry as a double."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat.reshape(len(column), dims)).astype(np.int64) + shift


def bounded(batches: Iterable[pa.RecordBatch], dims: int, entries: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about as many vector entries, whatever their dimensions."""
    size = max(1, entries // max(1, dims))
    for b in batches:
        for at in range(0, len(b), size):
            yield b.slice(at, size)
