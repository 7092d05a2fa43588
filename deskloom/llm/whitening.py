"""Whitening of vectors by their first principal components, found without ever forming a covariance matrix.

Block Lanczos: a block of orthonormal vectors Q is multiplied by the covariance V in a distributed pass, each task adding up
(x - mean)^T ((x - mean) Q) over its rows; the product is orthogonalised twice against all blocks before it and becomes the next block. Where
columns vanish the space found is invariant, and random columns orthogonal to it start anew. The Ritz vectors of the whole basis
are accepted once their residuals V y - e y are below ``tolerance`` of the greatest value, or once the basis fills the space.
Only blocks of dims x block numbers reach the driver, added up in tasks before.

Rows: a null or empty vector, or one with a null, non-finite or too large entry (``vectors.LARGEST``), takes no part, nor does one
of another length than most have. Equal rows, rows with one key and null keys are rows of their own. A direction without variance is no component: an empty table,
a single row and equal rows have none. Where values tie, any orthonormal vectors of their space are components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vectors

FLAT = 1e-13  # a value below this part of the greatest is no variance


@dataclass(frozen=True)
class Whitening:
    """n, the sums of all dimensions, components as columns, their values, each one's share of the trace."""

    scale: int
    shift: int
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    passes: int

    @property
    def dims(self) -> int:
        return len(self.sums)


def _rows(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Columns ``vector`` and ``key0``, ... of the rows that take part, of whatever length."""
    return df.select(F.col(vector).alias("vector"), *(F.col(k).alias(f"key{i}") for i, k in enumerate(keys))).where(vectors.usable("vector"))


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the double arrays ``part``; those of many tasks are added up in a few before the driver has them."""
    spark = parts.sparkSession
    few = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(-1, width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tolist()], pa.list_(pa.float64()))})

    got = parts.repartition(few).mapInArrow(add, "part array<double>").collect()
    return np.sum([r["part"] for r in got], axis=0) if got else np.zeros(width)


def _totals(rows: DataFrame, scale: int, shift: int, dims: int) -> tuple[int, np.ndarray]:
    """Exact: the number of rows and each dimension's sum of integers; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for b in vectors.bounded(batches, dims):
            n, total = n + len(b), total + vectors.matrix(b.column(0), scale, shift, dims).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "sums": pa.array([[int(x) for x in total]], pa.list_(pa.decimal128(38, 0)))})

    parts = rows.select("vector").mapInArrow(run, "n long, sums array<decimal(38,0)>")
    each = parts.select("n", F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = {r["d"]: (r["n"], r["s"]) for r in each.collect()}  # a row for each dimension
    return (sums[0][0] if sums else 0), np.array([int(sums[d][1]) for d in range(dims)] if sums else [], dtype=object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums in whole numbers: 64-bit ones where they suffice, else Python's."""
    most = max((abs(int(s)) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
    return n * x - sums.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - sums


def _product(rows: DataFrame, scale: int, shift: int, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance times a block, in one pass over the rows."""
    dims, width = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, width))
        for b in vectors.bounded(batches, dims):
            x = _centred(vectors.matrix(b.column(0), scale, shift, dims), n, sums).astype(np.float64) / n
            total += x.T @ (x @ block)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    return _added(rows.select("vector").mapInArrow(run, "part array<double>"), dims * width).reshape(dims, width) / n


def _orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator, scale: float) -> np.ndarray:
    """The block's columns made orthonormal to the basis and each other; one that vanishes beside ``scale`` gives way to a random one.

    No more columns than the space has room for.
    """
    dims, taken = basis.shape
    for column in block.T:
        if basis.shape[1] == dims:
            break
        own = column.copy()
        for _ in range(2):
            own -= basis @ (basis.T @ own)
        size = np.linalg.norm(own)
        if size <= scale * 1e-14 * dims:  # breakdown: the space so far is invariant, a new direction starts
            own, size = random.standard_normal(dims), 1.0
            for _ in range(3):
                own -= basis @ (basis.T @ own)
                own /= np.linalg.norm(own)
        basis = np.hstack([basis, (own / size)[:, None]])
    return basis[:, taken:]


def fit(
    df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, block: int = 16, tolerance: float = 1e-13, seed: int = 1
) -> Whitening:
    """Up to ``components`` principal components of the integers floor(scale * entry) + shift of all rows, by falling value.

    ``block`` is the number of vectors multiplied in a pass, at least ``components``, so that as many tied values are found.
    """
    rows = _rows(df, vector)
    dims, _ = vectors.usual_length(rows, "vector")
    rows = rows.where(F.size("vector") == dims)
    n, sums = _totals(rows, scale, shift, dims)
    nothing = Whitening(scale, shift, n, sums, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0)
    total = _total_deviation(rows, nothing)
    if not total:
        return nothing
    trace = total / n**3
    random, width = np.random.default_rng(seed), min(dims, max(block, components))
    q = _orthonormal(random.standard_normal((dims, width)), np.zeros((dims, 0)), random, 1.0)
    basis, image, passes = q, np.zeros((dims, 0)), 0
    while True:
        made = _product(rows, scale, shift, n, sums, q)
        image, passes = np.hstack([image, made]), passes + 1
        t = basis.T @ image
        values, ritz = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(values)[::-1][:components]
        left = image @ ritz[:, order] - basis @ (ritz[:, order] * values[order])  # V y - theta y, of the whole basis
        if basis.shape[1] == dims or (basis.shape[1] > components and np.linalg.norm(left, axis=0).max() <= tolerance * values.max()):
            break
        q = _orthonormal(made, basis, random, float(np.linalg.norm(t, 2)))
        basis = np.hstack([basis, q])
    found = np.linalg.qr(basis @ ritz[:, order])[0]
    sign = np.where(np.take_along_axis(found, np.abs(found).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    values = values[order]
    real = values > FLAT * values[0]
    return Whitening(scale, shift, n, sums, (found * sign)[:, real], values[real], values[real] / trace, passes)


def _of_model(df: DataFrame, model: Whitening, vector: str, *keys: str) -> DataFrame:
    return _rows(df, vector, *keys).where(F.size("vector") == model.dims)


def _total_deviation(rows: DataFrame, model: Whitening) -> int:
    dims = model.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.bounded(batches, dims):
            yield pa.RecordBatch.from_arrays([_squares(vectors.matrix(b.column(0), model.scale, model.shift, dims), model.n, model.sums)], ["deviation"])

    return int(rows.select("vector").mapInArrow(run, "deviation decimal(38,0)").agg(F.sum("deviation")).first()[0] or 0)


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """deviation: the exact sum over dimensions of (n * x - sum)^2."""
    c = _centred(x, n, sums)
    if c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * max(1, len(sums)) >= 1 << 63:
        c = c.astype(object)
    found = (c * c).sum(axis=1)
    return pa.array([int(v) for v in found] if c.dtype == object else found, pa.decimal128(38, 0) if c.dtype == object else pa.int64()).cast(pa.decimal128(38, 0))


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    centred = _centred(x, model.n, model.sums).astype(np.float64) / model.n
    return centred @ model.components / np.sqrt(model.values)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance, centred on their own mean, minus the identity."""
    k, dims = len(model.values), model.dims
    if not k:
        return 0.0
    rows = _of_model(df, model, vector)

    def added(width: int, of) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in vectors.bounded(batches, dims):
                total += of(_whitened(vectors.matrix(b.column(0), model.scale, model.shift, dims), model)).ravel()
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tolist()], pa.list_(pa.float64()))})

        return _added(rows.mapInArrow(run, "part array<double>"), width) / model.n

    mean = added(k, lambda w: w.sum(axis=0))
    covariance = added(k * k, lambda w: (w - mean).T @ (w - mean)).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, deviation (decimal), whitened (an array, by component) of each row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.bounded(batches, model.dims):
            x = vectors.matrix(b.column(0), model.scale, model.shift, model.dims)
            w = _whitened(x, model)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column(1), _squares(x, model.n, model.sums), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["key", "deviation", "whitened"]
            )

    rows = _of_model(df, model, vector, key)
    return rows.mapInArrow(run, f"key {rows.schema['key0'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
