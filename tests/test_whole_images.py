"""The transform file queries encode and check whole images, not a corner."""

import numpy as np
import pyarrow as pa
import pytest

from tessella.plans import codec_catalog
from tessella.sources import dct_file

H, W = 36, 52


@pytest.fixture
def seen(monkeypatch):
    """Shapes of what is encoded."""
    shapes, encode, best = [], dct_file.encode, dct_file.encode_best
    monkeypatch.setattr(dct_file, "encode", lambda rgb, *a, **k: (shapes.append(rgb.shape), encode(rgb, *a, **k))[1])
    monkeypatch.setattr(dct_file, "encode_best", lambda rgb, *a, **k: (shapes.append(rgb.shape), best(rgb, *a, **k))[1])
    return shapes


class Frame:
    """Stands for a DataFrame and keeps the kernel that it is given."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def image():
    return np.random.default_rng(5).integers(0, 256, (H, W, 4)).astype(np.uint8)


def test_library_encodes_the_whole_image(monkeypatch, seen):
    monkeypatch.setattr(codec_catalog, "images", lambda *_: None)
    monkeypatch.setattr(codec_catalog, "_per_image", lambda df, schema, one: one)
    assert codec_catalog.transform_file_library(None, "")(image()) == (H * W, True)
    assert seen and set(seen) == {(H, W, 3)}


def test_presets_encode_the_whole_image(spark, monkeypatch, seen):
    frame = Frame()
    monkeypatch.setattr(codec_catalog, "images", lambda *_: frame)
    monkeypatch.setattr(codec_catalog.tables, "spread", lambda *_: frame)
    run = codec_catalog.transform_file_presets(None, "").run
    batch = pa.RecordBatch.from_pydict({"image_id": ["0"], "preset": ["2"], "width": [W], "height": [H], "rgba": [image().tobytes()]})
    assert next(iter(run([batch]))).column(2).to_pylist() == [0]
    assert seen == [(H, W, 3)]


def test_places_of_a_unit_decode_it_once(monkeypatch):
    """A unit is decoded once to be compared whole and once for the places read alone, all of which are asked for."""
    t = dct_file.Transformed(dct_file.encode(image()[..., :3], "2"))
    px, units, places = t.pixels(), [], []
    unit, sample = dct_file.Transformed.unit, dct_file.Transformed.sample
    monkeypatch.setattr(dct_file.Transformed, "unit", lambda self, k: (units.append(k), unit(self, k))[1])
    monkeypatch.setattr(dct_file.Transformed, "sample", lambda self, x, y: (places.append((x, y)), sample(self, x, y))[1])
    assert codec_catalog._unit_mismatches(t, px) == 0
    assert sorted(places) == [(x, y) for x in range(0, W, 5) for y in range(0, H, 5)]
    assert sorted(units) == sorted([*range(t.layout.units)] * 2)
    wrong = px.copy()
    wrong[20, 35] ^= 1  # seen in its unit and read alone
    wrong[21, 36] ^= 1  # seen in its unit only
    assert codec_catalog._unit_mismatches(t, wrong) == 3
