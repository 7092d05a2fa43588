import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.llm import dual_tree as T, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every=50, relabel=True, positives=5, negatives=3):
    own = []
    for i, v, y in rows:
        if y is None or not v or any(c is None or not math.isfinite(c) for c in v) or len(v) != len(rows[0][1]):
            continue
        y = (y + 1) % 10 if relabel and i is not None and i % 7 == 0 else y
        own.append((i, [math.floor(256 * c) for c in v], y))
    big, out = 1 << 63, []
    for at, (i, v, y) in enumerate(own):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j if j is not None else big, z) for k, (j, w, z) in enumerate(own) if k != at)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            near = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j if j != big else None, r, k if k != big else None, -s, -t) for r, (t, k, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


def some(n, dims=12, seed=1, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((10, dims))
    return [(i, [float(np.float32(c)) for c in centres[y] + spread * r.standard_normal(dims)], int(y)) for i, y in enumerate(r.integers(0, 10, n))]


def result(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_query_like_brute_force_with_odd_rows(spark, tmp_path):
    rows = some(900)
    rows += [(i, rows[50][1], 3) for i in range(1000, 1300)]  # one very common vector
    rows += [(None, rows[50][1], 4), (100, rows[100][1], rows[100][2]), (150, rows[7][1], 2), (2000, None, 1), (2050, [float("nan")] * 12, 1), (2100, [None] * 12, 1)]
    rows += [(2150, [1.0] * 3, 1), (2200, [], 1), (2250, rows[3][1], None), (2300, [float("-inf")] * 12, 2)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = by_hand(rows)
    assert result(queries.op12_hard_negatives(spark, str(tmp_path))) == want and len(want) > 100


@pytest.mark.parametrize(("spread", "part_rows"), [(0.05, 64), (1.0, 200)])
def test_small_parts_and_close_clusters(spark, spread, part_rows):
    rows = some(1500, seed=5, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "leaf": F.lit(1.5), "anchor": F.lit(True)})
    got = result(T.mine(df, F.col("vec_id") % 20 == 0, part_rows=part_rows, positives=2, negatives=4))
    assert got == by_hand(rows, every=20, relabel=False, positives=2, negatives=4)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0], 1)], [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [0.5], 2)], [(50, None, 1)]])
def test_nothing_to_find(spark, rows):
    assert T.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_intervals_hold_and_whole_groups_are_pruned():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 1, (400, 6)) for m in (-40, 0, 40)]).round()
    trees = []
    for part in (x, x[::10]):
        order = T.arranged(part, 16)
        trees.append(T.Tree(np.arange(len(part)), np.arange(len(part)), np.zeros(len(part), int), T._bytes(part[order].astype(int)), 16))
    c, a = trees
    for la in range(len(a.edges)):
        for lc in range(len(c.edges)):
            for i in range(len(a.edges[la]) - 1):
                least, most = T.interval(a.centres[la][i], a.radii[la][i], a.sizes[la][i], c.centres[lc], c.radii[lc], c.sizes[lc])
                got = a.x[a.edges[la][i] : a.edges[la][i + 1]] @ c.x.T
                e = c.edges[lc]
                assert all(least[j] <= got[:, e[j] : e[j + 1]].min() and got[:, e[j] : e[j + 1]].max() <= most[j] for j in range(len(e) - 1))
    n = len(a.rows)
    slots = T.Slots(np.arange(n, dtype=np.int32), np.full(n, 9000), np.full(n, T.HIGH), 3, True)
    i, j, _ = T._leaf_pairs(a, c, slots)
    assert 0 < len(i) < (len(a.edges[-1]) - 1) * (len(c.edges[-1]) - 1) / 2


def test_scores_are_exact_at_every_width():
    r = np.random.default_rng(8)
    for top in (100, 1 << 20, 1 << 22):
        a, c = (r.integers(-top, top, (5, 30)) for _ in range(2))
        most = float(np.sqrt((a.astype(float) ** 2).sum(1).max() * (c.astype(float) ** 2).sum(1).max()))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in c] for u in a]
        assert T.scores(a.astype(float), c.astype(float), most).tolist() == want
