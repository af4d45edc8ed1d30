"""A source that reads ranges of units: pushed conditions, skipped ranges, equal pixels."""

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from tessella.operators import settings_search
from tessella.sources import dct_file, palette_file, tables, unit_source


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("units"), np.random.default_rng(1)
    images = {}
    for name, (h, w) in {"a": (50, 70), "b": (16, 16)}.items():
        data = dct_file.encode(rng.integers(0, 256, (h, w, 3)), "2", 60)
        (root / f"{name}.dct").write_bytes(data)
        images[name] = dct_file.Transformed(data).pixels()
    (root / "_hidden").write_bytes(b"x")
    return str(root), images


def test_ranges_and_pixels(spark, folder):
    root, images = folder
    units = unit_source.read_units(spark, root, units=3)
    assert units.rdd.getNumPartitions() == 8  # 20 units and 1
    got = {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in tables.decode_units(units).collect()}
    assert got == {(n, y, x): tuple(map(int, px[y, x])) for n, px in images.items() for y in range(px.shape[0]) for x in range(px.shape[1])}


@pytest.mark.parametrize("condition,parts", [("unit >= 4 and unit < 8", 2), ("unit = 19", 1), ("unit in (0, 19)", 3), ("image_id = 'b'", 1), ("unit > 25", 1), ("unit between 2 and 3 and length(record) > 0", 1)])
def test_conditions_skip_ranges(spark, folder, condition, parts):
    units = unit_source.read_units(spark, folder[0], units=3)
    some = units.where(condition)
    assert some.rdd.getNumPartitions() == parts
    every = {(r["image_id"], r["unit"], bytes(r["record"])) for r in units.collect()}
    kept = [(r["image_id"], r["unit"], bytes(r["record"])) for r in some.collect()]
    want = {("unit >= 4 and unit < 8"): lambda n, u: 4 <= u < 8, "unit = 19": lambda n, u: u == 19, "unit in (0, 19)": lambda n, u: u in (0, 19), "image_id = 'b'": lambda n, u: n == "b", "unit > 25": lambda n, u: False}.get(condition, lambda n, u: 2 <= u <= 3)
    assert sorted(kept) == sorted(r for r in every if want(*r[:2]))


def test_what_is_pushed(folder):
    reader = unit_source.UnitReader(folder[0], 4)
    other = StringContains(("image_id",), "a")
    assert list(reader.pushFilters([GreaterThan(("unit",), 3), LessThanOrEqual(("unit",), 9), other, In(("unit",), (5, 30))])) == [other]
    assert [(p.first, p.end) for p in reader.partitions()] == [(5, 9)]
    assert list(unit_source.UnitReader(folder[0], 4).pushFilters([EqualTo(("image_id",), "b")])) == []


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.dct").write_bytes(b"no image" * 20)
    with pytest.raises(ValueError, match="not a transform image"):
        unit_source.UnitReader(str(tmp_path), 4).partitions()


def test_faults_of_columns_are_those_of_the_reader(spark):
    rows = [(w, b, n, g, p, t, e) for w in (0, 5) for b in (2, 3, 4, 512) for n in (1, 2, 8, 32) for g in (4, 256, 512) for p in (1, 3, 256) for t in (20, 24) for e in (0, 1, 2)]
    names = ["width", "block", "local", "shared", "palettes", "bits", "extra"]
    from pyspark.sql import functions as F

    c = F.col
    given = F.ceil(c("width") / c("block")) * F.ceil(F.lit(2) / c("block")) + (c("extra") == 1).cast("int")
    fault = settings_search.palette_fault(*[F.lit(2) if n == "height" else c(n) for n in ("width", "height", "block", "local", "shared", "palettes", "bits")], given, F.when(c("extra") == 2, 300).otherwise(7))
    got = {tuple(r)[:-1]: r["fault"] for r in spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).withColumn("fault", fault).collect()}
    for w, b, n, g, p, t, e in rows:
        count = -(-w // b) * -(-2 // b) + (e == 1)
        try:
            palette_file.PaletteImage(w, 2, b, np.full((p, g, 3), 300 if e == 2 else 7), np.zeros(count, dtype=np.int64), np.zeros((count, n), dtype=np.int64), None if n == b * b else np.zeros((2, w), dtype=np.int64), t).check()
            want = ""
        except ValueError as err:
            want = str(err)
        assert got[w, b, n, g, p, t, e] == want


def test_lists_on_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"x","path":"p"}\n{"id":"y","path":"q","class":"c"}\n')
    asked = spark.createDataFrame([("y",)], "id string")
    assert [r["path"] for r in tables.image_list(spark, str(tmp_path), asked, lines=True).collect()] == ["q"]
    with pytest.raises(ValueError, match="unknown id z"):
        tables.image_list(spark, str(tmp_path), ["x", "z"], lines=True)
    (tmp_path / "b.json").write_text('{"id":"x","path":"r"}\n')
    with pytest.raises(ValueError, match="not unique"):
        tables.image_list(spark, str(tmp_path), lines=True)


def test_a_manifest_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b", "a", "c"):
        (tmp_path / "in" / f"{name}.ppm").write_bytes(b"x")
    out = tables.manifest_lines(spark, str(tmp_path / "in"), "*.ppm", str(tmp_path / "out")).collect()
    assert sorted((r["name"], r["is_default"]) for r in out) == [("a.ppm", True), ("b.ppm", False), ("c.ppm", False)]
