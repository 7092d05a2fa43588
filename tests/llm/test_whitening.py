import math

import numpy as np
import pytest

from deskloom.llm import queries, whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows):
    """n, sums, covariance in plain numbers."""
    x = [[math.floor(1024 * c) + 100_000 for c in r] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    return x, n, sums, centred, centred.T @ centred / n


def random_rows(n=300, dims=40, seed=2):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dims)) * np.linspace(2, 0.2, dims) + r.standard_normal(dims)).astype(np.float32)


def test_query_like_dense_eigenvectors(spark, tmp_path):
    v = random_rows()
    rows = [(i, [float(c) for c in r], 1) for i, r in enumerate(v)]
    bad = [(900, None, 1), (901, [float("nan")] * 40, 1), (902, [None] + [0.0] * 39, 1), (903, [float("inf")] + [0.0] * 39, 1), (904, [], 1), (905, [1.0] * 7, 1)]
    spark.createDataFrame([*rows, *bad, (None, *rows[0][1:]), rows[3]], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_whitening(spark, str(tmp_path)).toPandas()
    v = [*v, v[0], v[3]]
    x, n, sums, centred, cov = by_hand(v)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert len(got) == 8 * n and set(got["component"]) == set(range(1, 9)) and set(got["n"]) == {n}
    want = centred @ vectors / np.sqrt(values)
    for i in (1, 7, 250):
        own = got[got["vec_id"] == i].sort_values("component")
        assert set(own["deviation"]) == {sum((n * c - s) ** 2 for c, s in zip(x[i], sums, strict=True))}
        assert np.allclose(np.abs(own["whitened"]), np.abs(want[i]), rtol=0, atol=1e-9)
    signs = np.array([np.sign(got[got["vec_id"] == i].sort_values("component")["whitened"].to_numpy() * want[i]) for i in range(1, 300) if i != 3])
    clear = np.abs(np.array([want[i] for i in range(1, 300) if i != 3])) > 1e-6
    assert all(len(set(signs[clear[:, k], k])) == 1 for k in range(8))
    shares = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values / np.trace(cov), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_many_passes_stop_at_small_residuals(spark):
    r = np.random.default_rng(4)
    low = r.standard_normal((200, 5)) @ r.standard_normal((5, 120)) * 5 + 0.02 * r.standard_normal((200, 120))
    df = spark.createDataFrame([(i, [float(c) for c in x], 1) for i, x in enumerate(low)], SCHEMA)
    model = W.fit(df, components=4, block=4)
    _, _, _, _, cov = by_hand(np.array(low, dtype=np.float32))
    values = np.linalg.eigvalsh(cov)[::-1][:4]
    assert np.allclose(model.values, values, rtol=1e-11) and model.passes < 15
    assert np.abs(cov @ model.components - model.components * model.values).max() < 1e-11 * values[0]
    assert W.identity_error(df, model) < 1e-9


def test_ties_flat_directions_and_breakdown(spark):
    cross = [[s * 2.0 if i == j else 0.0 for i in range(10)] for j in range(10) for s in (1, -1)]  # all values equal
    tied = W.fit(spark.createDataFrame([(i, c, 1) for i, c in enumerate(cross)], SCHEMA), block=3, components=3)
    assert len(tied.values) == 3 and np.allclose(tied.values, tied.values[0]) and np.allclose(tied.components.T @ tied.components, np.eye(3))
    plane = [[float(a), float(b), 1.0, 0.0, 5.0] for a in range(4) for b in range(3)]
    flat = W.fit(spark.createDataFrame([(i, c, 1) for i, c in enumerate(plane)], SCHEMA))
    assert len(flat.values) == 2 and math.isclose(flat.explained.sum(), 1.0, rel_tol=1e-12)
    assert W.identity_error(spark.createDataFrame([(i, c, 1) for i, c in enumerate(plane)], SCHEMA), flat) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1)] * 3, [(1, None, 1), (2, [], 2)]])
def test_without_variance_there_are_no_components(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_whitening(spark, str(tmp_path)).count() == 0


def test_whole_numbers_beyond_64_bits_and_clashing_columns(spark):
    rows = [(1, [1.0e6, 0.0], 1, 1), (2, [-1.0e6, 1.0], 1, 1), (3, [0.0, 2.0], 1, 1)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, key int, n int")
    model = W.fit(df, vector="vector", scale=1 << 18)
    got = {r["key"]: r["deviation"] for r in W.transform(df, model, "id", "vector").collect()}
    x = [[(1 << 18) * int(c) + 100_000 for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {k: int(v) for k, v in got.items()} == {str(r[0]): sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for r, v in zip(rows, x, strict=True)}
    assert max(got.values()) > 1 << 63
