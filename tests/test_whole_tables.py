"""Registered queries read every row of their tables: against brute force, with more rows than any filter of theirs once let through."""

import numpy as np
import pytest

from tessella.operators import matching, prefix
from tessella.plans import catalog

N = 150


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    x = np.random.default_rng(7).normal(size=(N, 64)).clip(-1, 1).astype(np.float32)
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, x


def test_hamming_dictionary_has_every_block(spark, vectors):
    folder, x = vectors
    bits = x >= 0
    d = (bits[:, None] != bits[None, :8]).sum(axis=2)
    want = {(b, int(d[b].argmin()), int(d[b].min())) for b in range(N)}
    assert {tuple(r) for r in catalog.hamming_dictionary(spark, folder).collect()} == want


def test_dihedral_min_has_every_block(spark, vectors):
    folder, x = vectors
    bits = x >= 0
    places = [[y * 8 + x_ for x_, y in (matching.dihedral(i % 8, i // 8, 8, t) for i in range(64))] for t in range(8)]
    want = set()
    for b in range(N):
        d, proto, t = min((int((bits[b] != bits[q][places[t]]).sum()), q, t) for q in range(4) for t in range(8))
        want.add((b, proto, t, d))
    assert {tuple(r) for r in catalog.dihedral_min(spark, folder).collect()} == want


def test_bitmap_rank_has_every_block(spark, vectors):
    folder, x = vectors
    bits = (x >= 0).astype(int)
    below = bits.cumsum(axis=1) - bits
    want = {(b, p, int(bits[b, p]), int(below[b, p])) for b in range(N) for p in range(64)}
    assert {tuple(r) for r in catalog.bitmap_rank(spark, folder).collect()} == want


def test_gaussian_window_has_every_vector(spark, vectors):
    folder, x = vectors
    s = np.floor((x.astype(np.float64) + 1) * 127.5)
    want = {(b, p): float(s[b, p - 5 : p + 6] @ np.array(prefix.gaussian_taps())) for b in range(N) for p in range(5, 59)}
    got = {(r["vec_id"], r["pos"]): r["smooth"] for r in catalog.gaussian_window(spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
