import random

import numpy as np
import pytest

from deskloom.llm import ngram_join as nj
from .conftest import frame


def brute(rows, size, num):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else (tuple(w[i : i + size]) for i in range(len(w) - size + 1))))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted(((k, len(s), k if not s else least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("size,num,block", [(3, 90, 2048), (5, 80, 2), (3, 60, 1), (2, 100, 4)])
def test_same_components_as_brute_force(spark, made, size, num, block):
    got = sorted((tuple(r)[:3] for r in nj.join(frame(spark, made), size, num, 100, block_rows=block).collect()), key=repr)
    assert got == brute(made, size, num)


@pytest.mark.parametrize("num", [50, 80, 90, 97])
def test_bands_and_cells_lose_no_link(num):
    """Sets with as many differences as a link may have, spread at will, share a signature, and as many as either needs."""
    r, bound = np.random.default_rng(3), nj.Bound(num, 100)
    bands = nj.Bands(bound)
    for _ in range(1500):
        n = int(r.integers(1, 60)) if r.random() < 0.6 else int(r.integers(60, 900))
        m = int(r.integers(n, bound.partner(n) + 1))
        apart = bound.difference(n + m)
        both = max(0, (n + m - apart + 1) // 2)
        x, y = (np.unique(r.integers(0, 1 << 63, both, np.uint64)),) * 2
        x, y = (np.unique(np.concatenate([s, r.integers(0, 1 << 63, k - both, np.uint64)])) for s, k in ((x, n), (y, m)))
        if len(np.setxor1d(x, y)) and len(x) == n and len(y) == m:
            a, b = ({int(v): least for _, least, s in nj.signatures(g, bands) for v in s} for g in (x, y))
            met = a.keys() & b.keys()
            assert met, (n, m)
            assert any(len([v for v in met if v & 1 == p]) >= max(max(s[v] for v in met if v & 1 == p) for s in (a, b)) for p in {v & 1 for v in met})


@pytest.mark.parametrize("num", [60, 80, 90])
def test_product_of_a_block(num):
    r, bound = np.random.default_rng(num), nj.Bound(num, 100)
    for most in (50, 4_000_000):
        base = r.integers(0, 400, 90)
        sets = [np.unique(np.where(r.random(90) < r.choice([0.02, 0.1, 0.4, 1.0]), r.integers(0, 400, 90), base)).astype(np.uint64) for _ in range(60)]
        least = list(range(60))
        for _ in range(60):
            for i in range(60):
                for j in range(60):
                    if len(np.setxor1d(sets[i], sets[j])) <= bound.difference(len(sets[i]) + len(sets[j])):
                        least[i] = least[j] = min(least[i], least[j])
        assert nj.product(sets, bound, most).tolist() == least


def test_a_tile_sends_a_shared_signature_once():
    rows = nj._tile([np.array([5, 7]), np.array([5]), np.array([5, 9]), np.array([5])], [11, 0, 13, 11]).to_pylist()
    assert sorted((x["sig"], x["node"], x["place"]) for x in rows) == [(5, 0, 0), (5, 0, 1), (5, 11, 11), (5, 13, 13), (7, 11, 0), (9, 13, 0)]


def test_large_groups_by_their_differences(spark):
    """Many near copies around one text, so that links must come through differences from a leader."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in r.sample(range(80), r.choice([0, 1, 1, 2, 3])):
            own[at] = f"x{r.randrange(4)}"
        rows.append((i, " ".join(own)))
    got = sorted((tuple(x)[:3] for x in nj.join(frame(spark, rows), 3, 90, 100, block_rows=4).collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_a_minority_of_near_copies_in_a_large_block_forms_no_pairs(spark, monkeypatch):
    """Near copies among more texts of other kinds, so that none of them is near the block's reference."""
    rows = [(i, " ".join([*(f"a{j}" for j in range(60)), f"x{i}"])) for i in range(60)]
    rows += [(60 + i, " ".join(f"d{i}-{j}" for j in range(60))) for i in range(70)]
    seen, components = [], nj.components
    monkeypatch.setattr(nj, "_blocks", lambda shared, nodes: nodes.selectExpr("node", "1L AS block"))
    monkeypatch.setattr(nj, "components", lambda edges: seen.append(edges.count()) or components(edges))
    got = sorted((tuple(x)[:3] for x in nj.join(frame(spark, rows), 3, 90, 100, block_rows=4).collect()), key=repr)
    assert got == brute(rows, 3, 90)
    assert seen[-1] <= 2 * len(rows)


def test_empty_table(spark):
    assert nj.join(frame(spark, []), 3, 90, 100).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in nj.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
