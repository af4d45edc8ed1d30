"""Tree join, Hamming join, farthest choices and the palette of a corpus against brute force."""

import collections

import numpy as np
import pytest

from tessella.operators import clustering, corpus_palette, farthest, hamming_join, tree_join


@pytest.mark.parametrize("leaf,spread", [(2, 40), (8, 6), (64, 200)])
def test_tree_join_by_brute_force(spark, leaf, spread):
    rng = np.random.default_rng(leaf)
    entries = [(i, *(int(v) for v in rng.integers(-spread, spread, 3))) for i in range(220)] + [(900, None, 1, 1), (901, 5000, 5000, 5000), (3, 1, 1, 1), (2, 1, 1, 1)]
    points = [tuple(int(v) for v in rng.integers(-spread - 9, spread + 9, 3)) for _ in range(300)] + [(None, 1, 2), (9000, 0, 0), (1, 1, 1), (1, 1, 1)]
    got = tree_join.tree_nearest(spark.createDataFrame(points, "r long, g long, b long").repartition(4), spark.createDataFrame(entries, "idx long, r long, g long, b long").repartition(3), ["r", "g", "b"], leaf=leaf).collect()
    fine = [e for e in entries if None not in e]
    want = {}
    for p in {p for p in points if None not in p}:
        d, i = min((sum((a - b) ** 2 for a, b in zip(p, e[1:], strict=True)), e[0]) for e in fine)
        want[p] = (i, d)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_tree_join_of_two_dimensions_and_of_nothing(spark):
    rng = np.random.default_rng(2)
    entries, points = rng.normal(size=(150, 2)), rng.normal(size=(90, 2))
    e = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(entries)], "idx long, x double, y double")
    p = spark.createDataFrame([tuple(map(float, v)) for v in points], "x double, y double")
    got = {(r["x"], r["y"]): r["idx"] for r in tree_join.tree_nearest(p, e, ["x", "y"], leaf=4).collect()}
    assert got == {tuple(map(float, v)): int(((entries - v) ** 2).sum(axis=1).argmin()) for v in points}
    assert tree_join.tree_nearest(p, e.limit(0), ["x", "y"]).count() == 0 and tree_join.tree_nearest(p.limit(0), e, ["x", "y"]).count() == 0


def test_tree_visits_few_cells():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(4096, 3))
    tree = tree_join.Tree(x, 8)
    cells = tree.cells(x)
    tree.bounded({int(c): (x[cells == c].min(axis=0), x[cells == c].max(axis=0)) for c in np.unique(cells)}, 3)
    q = rng.uniform(size=(500, 3))
    near = ((q[:, None] - x[None]) ** 2).sum(axis=2).min(axis=1)
    row, cell = tree.visits(q, near)
    assert len(np.unique(cells)) == 256 and len(row) < 500 * 8
    assert all(cells[((q[i] - x) ** 2).sum(axis=1).argmin()] in cell[row == i] for i in range(500))


def hamming(a, b):
    return (a ^ b).bit_count()


@pytest.mark.parametrize("places,distance,most", [(16, 2, 4), (16, 2, 256), (20, 3, 8), (64, 1, 2)])
def test_hamming_pairs_by_brute_force(spark, places, distance, most):
    rng = np.random.default_rng(places)
    words = {int(v) for v in rng.integers(0, 1 << min(places, 62), 150)} | {int(v) for v in rng.integers(0, 64, 60)}
    words |= {w ^ (1 << int(rng.integers(0, places))) for w in list(words)[:60]}
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    got = [tuple(r) for r in hamming_join.pairs(spark.createDataFrame([(w,) for w in signed], "word long").repartition(3), distance, places, most).collect()]
    whole = (1 << 64) - 1
    want = {(a, b, hamming(a & whole, b & whole)) for a in signed for b in signed if a < b and hamming(a & whole, b & whole) <= distance}
    assert set(got) == want and len(got) == len(want) > 20


def test_near_patterns_by_brute_force(spark):
    rng = np.random.default_rng(9)
    bits = [[int(v) for v in rng.integers(0, 2, 64)] for _ in range(12)]
    rows = []
    for i in range(150):
        p = list(bits[0 if i % 3 == 0 else int(rng.integers(0, 12))])
        for at in rng.integers(0, 64, int(rng.integers(0, 5))):
            p[at] ^= 1
        rows.append((i, p))
    rows += [(500, None), (501, [None] * 64), (502, [1] * 65), (None, bits[1])]
    got = {r["id"]: tuple(r)[1:] for r in hamming_join.near_patterns(spark.createDataFrame(rows, "id long, p array<int>"), 6).collect()}
    usable = [(i, int("".join(map(str, p)), 2)) for i, p in rows if p is not None and None not in p and len(p) <= 64]
    heads = {w: min((i for i, v in usable if v == w and i is not None), default=None) for _, w in usable}
    assert len(got) == len(rows)
    for i, w in usable:
        near = [(hamming(w, v), j) for j, v in usable if (j, v) != (i, w) and hamming(w, v) <= 6]
        other = [(d, heads[v]) for v in heads if v != w and (d := hamming(w, v)) <= 6]
        assert got[i][:3] == (heads[w], len(near), min((d for d, _ in near), default=None))
        assert got[i][3] == (min((d, h) for d, h in other if h is not None)[1] if other and all(h is not None for _, h in other) else got[i][3])
    assert all(got[i] == (None, 0, None, None) for i in (500, 501, 502))


def test_farthest_beyond_a_refresh(spark, monkeypatch):
    monkeypatch.setattr(farthest, "REFRESH", 3)
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 50, (80, 3)), axis=0)
    weights = rng.integers(1, 9, len(points)).astype(float)
    df = spark.createDataFrame([(i, *map(int, p), int(w)) for i, (p, w) in enumerate(zip(points, weights, strict=True))], "first long, r long, g long, b long, n long")
    got = corpus_palette.spread_centres(df, 11)
    assert got == clustering.spread_start(points.astype(float), weights, 11, "k-means").tolist()
    assert len(corpus_palette.spread_centres(df, 500)) == len(points)


@pytest.mark.parametrize("k", [1, 7, 300])
def test_corpus_palette_by_brute_force(spark, k):
    rng = np.random.default_rng(k)
    px = [(i, *(int(v) * 20 for v in rng.integers(0, 6, 3)), 255 if i % 9 else 0) for i in range(900)]
    if k > 256:
        with pytest.raises(ValueError):
            corpus_palette.corpus_palette(spark.createDataFrame(px, "pos long, r long, g long, b long, a long"), k)
        return
    got = corpus_palette.corpus_palette(spark.createDataFrame(px, "pos long, r long, g long, b long, a long").repartition(5), k, rounds=9).collect()
    count, first = collections.Counter(p[1:4] for p in px if p[4]), {}
    for p in px:
        if p[4]:
            first.setdefault(p[1:4], p[0])
    colors = sorted(count, key=first.get)
    x, w = np.array(colors, dtype=float), np.array([count[v] for v in colors], dtype=float)
    centres = clustering.spread_start(x, w, k, "k-means")
    for _ in range(9):
        own = clustering.nearest(x, centres)
        centres = np.array([[(w[own == j] @ x[own == j, v]) / w[own == j].sum() for v in range(3)] if (own == j).any() else centres[j] for j in range(k)])
    own = clustering.nearest(x, centres)
    best = clustering.medoids(x, w, own, centres)
    sizes = np.bincount(own, w, minlength=k)
    place = {j: i for i, j in enumerate(np.lexsort((np.arange(k), -sizes)).tolist())}
    assert {tuple(r) for r in got} == {(*c, count[c], place[own[i]], *colors[best[own[i]]]) for i, c in enumerate(colors)}


def test_corpus_palette_of_nothing(spark):
    assert corpus_palette.corpus_palette(spark.createDataFrame([(1, 2, 3, 4, 0)], "pos long, r long, g long, b long, a long"), 4).count() == 0


def test_tree_and_hamming_plans_have_no_cross_join(spark):
    from tessella.plans import range_catalog

    for f in (range_catalog.tree_nearest_colors, range_catalog.near_patterns):
        text = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
