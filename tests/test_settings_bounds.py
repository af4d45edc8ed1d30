"""Bounds of palette settings against encodings, and the steps that they speed up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import clustering, palette_encoder, settings_bounds
from tessella.operators.palette_encoder import Settings
from tessella.sources import tables

GRID = [{"block": b, "local": n, "shared": g, "palettes": p, "bits": k} for b in (2, 4, 8, 16) for n in (2, 4, 8, 16) for g in (16, 64) if n <= min(g, b * b) for p in (1, 4) for k in (16, 24)]


def picture(kind: str, h: int, w: int) -> np.ndarray:
    rng = np.random.default_rng(len(kind) + h)
    rgba = np.full((h, w, 4), 255, dtype=np.uint8)
    if kind == "noise":
        rgba[..., :3] = rng.integers(0, 256, (h, w, 3))
    elif kind == "few":
        rgba[..., :3] = rng.integers(0, 256, (7, 3))[rng.integers(0, 7, (h, w))]
    elif kind == "ramp":
        rgba[..., :3] = (np.arange(h)[:, None, None] * 3 + np.arange(w)[None, :, None] * [1, 2, 4] + rng.integers(0, 9, (h, w, 3))) % 256
    if kind != "few":
        rgba[rng.random((h, w)) < 0.1, 3] = 0
    if kind == "clear":
        rgba[..., 3] = 0
    return rgba


def encoded(rgba, t) -> int:
    s = Settings(t["block"], t["local"], t["shared"], t["palettes"], t["bits"], "rgb", "k-means", passes=0)
    return round(palette_encoder.compress(rgba, s).mse * rgba.shape[0] * rgba.shape[1] * 3)


@pytest.mark.parametrize(("kind", "h", "w"), [("noise", 21, 30), ("few", 16, 17), ("ramp", 30, 19), ("clear", 5, 9), ("noise", 1, 1), ("ramp", 3, 140)])
def test_least_errors_are_those_of_encoding_all(kind, h, w):
    rgba = picture(kind, h, w)
    tried = [t | {"family": t["palettes"] == 1 and t["bits"] == 24, "inside": i % 9 != 4} for i, t in enumerate(GRID)]
    got, want = settings_bounds.least_errors(rgba, tried), [encoded(rgba, t) for t in tried]
    assert all(g in (None, e) for g, e in zip(got, want, strict=True))
    assert all(g is not None for g, t in zip(got, tried, strict=True) if not t["inside"])
    for rows in (range(len(tried)), [i for i, t in enumerate(tried) if t["family"]]):
        inside = [i for i in rows if tried[i]["inside"]]
        least = min(want[i] for i in inside)
        assert [i for i in inside if want[i] == least] == [i for i in inside if got[i] == least]


def test_few_settings_are_encoded(monkeypatch):
    calls, compress = [], palette_encoder.compress
    monkeypatch.setattr(palette_encoder, "compress", lambda rgba, s: calls.append(s) or compress(rgba, s))
    settings_bounds.least_errors(picture("noise", 24, 40), [t | {"family": t["palettes"] == 1, "inside": True} for t in GRID])
    assert len(calls) < len(GRID) // 10


def test_bounds_of_an_image_are_those_of_its_tiles(monkeypatch):
    rgba, s = picture("noise", 40, 50), Settings(8, 4, 32, 4, 24, "rgb", "k-means", passes=0)
    selectors = palette_encoder.cluster_blocks(palette_encoder.descriptors(rgba, 8, "rgb"), 4)
    made = palette_encoder.build_palettes(rgba, selectors, s)
    whole, free = settings_bounds._bound(rgba, *made, selectors, s, np.inf), settings_bounds._free_bounds(rgba, 8, {4})
    monkeypatch.setattr(settings_bounds, "TILE", 16)
    parts = settings_bounds._bound(rgba, *made, selectors, s, np.inf)
    assert parts[0] == pytest.approx(whole[0], rel=0.02) and parts[1] == whole[1]
    assert settings_bounds._free_bounds(rgba, 8, {4})[4] == pytest.approx(free[4])
    total = palette_encoder.compress(rgba, s).mse * 3 * (rgba[..., 3] != 0).sum()
    assert free[4] <= total and max(whole[0], parts[0]) <= total


@pytest.mark.parametrize("scale", [1, 1e-3, 1e6])
def test_nearest_by_a_product_is_nearest(scale):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (3000, 3)) * scale, rng.integers(0, 256, (40, 3)) * scale
    b[20:30] = b[:10]  # ties go to the first
    a[:500] = (b[rng.integers(0, 40, 500)] + b[rng.integers(0, 40, 500)]) / 2  # and so do pixels halfway
    assert len(a) * len(b) >= clustering.MANY
    assert (clustering.nearest(a, b) == clustering.distances(a, b).argmin(axis=1)).all()


def test_images_are_spread_after_a_grouping_by_their_keys(spark):
    n = 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        each = spark.range(400).groupBy((F.col("id") % 40).alias("image_id")).agg(F.count("*").alias("n"))
        assert tables.spread(each, "image_id").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
