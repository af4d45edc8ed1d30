"""Whitening, centroid clustering and benchmark windows against brute force, with odd rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import centroids, decontamination, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x int, n int, cluster int, w int"


def vectors(n, dim, seed, extra=()):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) * np.linspace(0.05, 0.4, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(None, x[0].tolist()), (3, x[3].tolist()), (3, x[4].tolist()), (900, None), (901, []), (902, [1.0]), (903, [float("nan")] * dim), (904, [None] + [0.5] * (dim - 1)), (905, [float("inf")] + [0.0] * (dim - 1)), (906, [0.0] * dim)]
    return [(i, v, 1, 2, 3, 4, 5) for i, v in [*rows, *bad, *extra]]


def usable(rows, dim):
    return [(r[0], np.array(r[1], dtype=np.float64)) for r in rows if r[1] is not None and len(r[1]) == dim and all(v is not None and math.isfinite(v) for v in r[1])]


# ------------------------------------------------------------------ whitening
@pytest.mark.parametrize("dim,tile", [(64, 32), (21, 8), (5, 32), (3, 1)])
def test_whitening_by_brute_force(spark, dim, tile):
    rows = vectors(150, dim, dim)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), tile=tile).collect()
    kept = usable(rows, dim)
    x = np.array([np.floor(1024 * v) + 100000 for _, v in kept])
    n, s = len(x), x.astype(np.int64).sum(axis=0)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u, k = e[::-1], u[:, ::-1], min(8, dim)
    want = collections.Counter((i, c + 1, n, int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)))) for (i, _), row in zip(kept, x) for c in range(k))
    assert collections.Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["component"], r["deviation"]].append(r["whitened"])
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    for c in range(k):
        w = centred @ u[:, c] / math.sqrt(e[c])
        mine = np.array([by[c + 1, int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)))][0] for row in x])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-7


def test_whitening_without_variance(spark):
    empty = spark.createDataFrame([], VECTORS)
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, 2, 3, 4, 5) for i in range(3)], VECTORS)
    flat = spark.createDataFrame([(i, [0.5, float(i)], 1, 2, 3, 4, 5) for i in range(3)], VECTORS)
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(same).count() == 0
    assert sorted((r["vec_id"], r["component"]) for r in whitening.whiten(flat).collect()) == [(0, 1), (1, 1), (2, 1)]
    assert whitening.whiten(empty).dtypes == whitening.whiten(flat).dtypes


def test_deviation_is_exact_or_null():
    y = np.array([[3.0, -4.0], [2.0**40, 1.0]])
    got = whitening._deviation(y, np.array([1, 2], dtype=np.int64), 1 << 20).to_pylist()
    assert got == [(3 * (1 << 20) - 1) ** 2 + (-4 * (1 << 20) - 2) ** 2, None]


def test_rows_in_blocks_change_nothing(spark):
    rows = spark.createDataFrame(vectors(90, 7, 1), VECTORS).where(F.col("vec_id") < 90).select(F.col("embedding").alias("x"))
    mean = np.arange(7.0)
    one, many = whitening.covariance(rows.coalesce(1), mean, 90, tile=7, block_rows=1000), whitening.covariance(rows.repartition(3), mean, 90, tile=2, block_rows=4)
    assert np.allclose(one, many, rtol=1e-12) and (many == many.T).all()


# ------------------------------------------------------------------ clustering
def clusters(rows, k=40, rounds=5, dim=64):
    kept = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(rows, dim)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x.tolist()) for i, x in kept if i is not None)[:k]
    c, x = np.array([v for _, v in start]), np.array([v for _, v in kept])
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            c = np.array([[int(t) // int((own == j).sum()) for t in x[own == j].sum(axis=0)] if (own == j).any() else c[j] for j in range(len(c))])
    least = d.min(axis=1)
    return [(kept[r][0], int(own[r]), int(least[r]), int(least[own == own[r]].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[own[r]].tolist())).encode()).hexdigest()) for r in range(len(x))]


@pytest.mark.parametrize("n", [3, 30, 300])
def test_clusters_by_brute_force(spark, n):
    far = [(5000 + i, (np.full(64, float(i)) / 3).tolist()) for i in range(20)]
    rows = vectors(n, 64, n, far) if n > 3 else [(i, v.tolist(), 1, 2, 3, 4, 5) for i, v in enumerate(np.eye(64)[:3])]
    if n > 3:
        rows = rows + rows[:7] * 3
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(clusters(rows))


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    out = centroids.cluster(empty)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(spark.createDataFrame([(None, [0.5] * 64, 1, 2, 3, 4, 5)], VECTORS)).count() == 0


def test_rings_leave_out_far_norms_only():
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(50, 64)) * rng.uniform(1, 3000, (50, 1))).astype(np.int64)
    c[7] = c[3]
    x = np.concatenate([c[rng.integers(0, 50, 400)] + rng.integers(-9, 10, (400, 64)), (c[:40] + c[1:41]) // 2])
    number, best, compared = centroids.Rings(c).nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and compared < 0.5 * d.size
    large = c * 4096
    assert (centroids.Rings(large).nearest(x * 4096)[1] == d.min(axis=1) * 4096**2).all()


def test_a_component_too_large_is_refused(spark):
    with pytest.raises(Exception, match="not below"):
        centroids.cluster(spark.createDataFrame([(1, [1e6] * 64, 1, 2, 3, 4, 5)], VECTORS)).count()


# ------------------------------------------------------------------ benchmark windows
DOCS = "doc_id long, text string, lang string, row int, words string, win int, h long"
ITEMS = "item_id long, text string, words int, len int, h int"


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contained(docs, items, size=10):
    windows = []
    for i, t in items:
        w = word_list(t)
        n = min(size, len(w))
        windows += [(i, w[a : a + n]) for a in range(len(w) - n + 1)] if n else []
    out = []
    for d, t in docs:
        w, hit, found = word_list(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit |= set(range(a, a + len(x)))
                    found.add(i)
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


def check_contained(spark, docs, items, **how):
    a = spark.createDataFrame([(d, t, "x", 1, "y", 2, 3) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEMS)
    got = decontamination.decontaminate(a.repartition(3), b, **how).collect()
    assert collections.Counter(map(tuple, got)) == contained(docs, items, how.get("window", 10))
    return got


def test_windows_by_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["alpha", "Beta", "gamma", "ÄRGER", "ünï", "x1", "42", "日本語", "é"]
    text = lambda n, of=9: " ,-".join(vocabulary[i] for i in rng.integers(0, of, n))
    items = [(i, text(int(rng.integers(8, 30)))) for i in range(30)] + [(40, text(25, 2)), (41, text(12, 1)), (7, text(15)), (None, text(14)), (None, text(14)), (42, None), (43, ""), (44, " .,- "), (45, "alpha beta 42"), (46, "日本語 x1"), (10, "alpha-BETA 42!")]
    docs = [(i, text(int(rng.integers(0, 80))) + " / " + (items[int(rng.integers(0, 36))][1] or "").upper() + "\n" + text(5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, ",;"), (None, items[3][1]), (None, items[3][1]), (5, text(40, 1)), (103, items[0][1]), (104, " ".join(items[0][1].split(" ,-")[:9])), (105, "Alpha beta 42"), (106, text(3000, 2)), (107, "a\x00b alpha\x7fBETA{42}")]
    got = check_contained(spark, docs, items)
    assert sum(r["contaminated"] for r in got) > 20 and sum(not r["contaminated"] for r in got) > 5
    check_contained(spark, docs, items[:36], window=3, shingle=2)


def test_one_word_items(spark):
    check_contained(spark, [(1, "a b c a"), (2, "b"), (3, "c c")], [(1, "A"), (2, "b c")])


def test_windows_of_nothing(spark):
    assert not any(r["contaminated"] for r in check_contained(spark, [(1, "a b c"), (2, None)], []))
    assert check_contained(spark, [], [(1, "a b c")]) == []


def test_passage_in_most_documents(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"start{i} {passage} end{i}" if i % 3 else f"clean{i} " + " ".join(f"w{j}" for j in range(59, -1, -1))) for i in range(90)]
    got = check_contained(spark, docs, [(1, passage), (2, "lead " + passage), (3, passage.replace("w30", "other"))])
    assert {(r["n_hit"], r["n_items"]) for r in got if r["contaminated"]} == {(60, 3)}


def test_texts_in_pieces(monkeypatch):
    text = ("Word1 ärger, " * 50 + "x" * 400 + " end").encode()
    clean = decontamination.words_of(text)
    whole = decontamination.word_hashes(clean)
    monkeypatch.setattr(decontamination, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, decontamination.word_hashes(clean), strict=True))
    assert [clean[a:b] for a, b in zip(*whole[1:])] == clean.split() and len(set(whole[0].tolist())) == len(set(clean.split()))
