"""Operators against plain Python, and the properties that the encoders promise."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import clustering, matching, palette_encoder, pixels, prefix, reports, sampling, transform
from tessella.sources import containers, dct_file, palette_file, tables
from tessella.workspace import Workspace


def smooth(h, w, noise=0):
    y, x = np.mgrid[0:h, 0:w]
    rgb = np.stack([128 + 60 * np.sin(x / 9), 100 + 50 * np.cos(y / 7), 90 + 40 * np.sin((x + y) / 17)], axis=-1) + np.random.default_rng(0).normal(0, noise, (h, w, 3))
    return np.dstack([np.clip(rgb, 0, 255).astype(np.uint8), np.full((h, w), 255, np.uint8)])


# ------------------------------------------------------------------ clustering
def test_two_exact_colours():
    rgba = np.array([[255, 0, 0, 255]] * 3 + [[0, 0, 255, 255]] * 2 + [[9, 9, 9, 0]])
    for method, space in itertools.product(clustering.METHODS, clustering.SPACES):
        q = clustering.quantise(*clustering.histogram(rgba), 2, method, space)
        assert q.palette.tolist() == [[255, 0, 0], [0, 0, 255]] and list(q.counts) == [3, 2]


def test_histogram_keeps_first_seen_order():
    colors, counts = clustering.histogram(np.array([[5, 5, 5, 255], [1, 1, 1, 255], [5, 5, 5, 9], [0, 0, 0, 0]]))
    assert colors.tolist() == [[5, 5, 5], [1, 1, 1]] and list(counts) == [2, 1]


def test_medians_ignore_an_outlier_and_medoids_are_members():
    colors = np.array([[10, 10, 10], [12, 12, 12], [14, 14, 14], [200, 200, 200]])
    counts = np.array([5.0, 5.0, 5.0, 1.0])
    assert clustering.quantise(colors, counts, 1, "k-medians", "rgb").palette.tolist() == [[12, 12, 12]]
    assert clustering.quantise(colors, counts, 1, "k-means", "rgb").palette.tolist() == [[24, 24, 24]]
    assert clustering.quantise(colors, counts, 1, "k-medoids", "rgb").palette[0].tolist() in colors.tolist()


def test_weighted_median():
    assert clustering.weighted_median(np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 2.0])) == 2.0
    assert clustering.weighted_median(np.array([1.0, 2.0]), np.array([1.0, 1.0])) == 1.0


def test_more_colours_never_cost_quality():
    hist = clustering.histogram(smooth(40, 40, 4).reshape(-1, 4))
    errors = []
    for k in (2, 8, 32):
        q = clustering.quantise(*hist, k, "k-means", "rgb")
        errors.append(((q.palette[q.slots].astype(int) - q.colors) ** 2).sum(axis=1) @ hist[1])
    assert errors[0] > errors[1] > errors[2]


def test_bad_settings_are_refused():
    for bad in ({"local": 3}, {"local": 32, "shared": 64}, {"local": 16, "shared": 8}, {"palettes": 256}, {"passes": 17}, {"dithering": "some"}):
        with pytest.raises(ValueError):
            palette_encoder.Settings(**bad)
    with pytest.raises(ValueError):
        clustering.quantise(np.zeros((1, 3)), np.ones(1), 1, "k-modes")


@pytest.mark.parametrize("settings", [{}, {"palettes": 8, "shared": 16}, {"block": 4, "local": 16}, {"space": "rgb", "method": "k-means", "color_bits": 16}, {"dithering": "bayer-2"}, {"dithering": "diffusion"}, {"diversity": 0.5}])
def test_encoder_round_trip_and_monotone_refinement(settings):
    rgba = smooth(37, 45, 5)
    rgba[:3, :5, 3] = 0
    e = palette_encoder.compress(rgba, palette_encoder.Settings(**settings))
    assert (palette_file.decode(palette_file.encode(e.image)).pixels() == e.pixels).all()
    assert all(b <= a for a, b in itertools.pairwise(e.errors)) and e.mse == e.errors[-1]


def test_many_palettes_beat_one():
    rgba = np.concatenate([smooth(32, 32, 3), smooth(32, 32, 3)[..., [2, 0, 1, 3]]], axis=1)
    one, four = (palette_encoder.compress(rgba, palette_encoder.Settings(palettes=p, shared=16, space="rgb")).mse for p in (1, 4))
    assert four < one


def test_diffusion_stays_in_its_block():
    rgba = smooth(8, 32)
    left = palette_encoder.compress(rgba, palette_encoder.Settings(dithering="diffusion", passes=0, shared=8, local=2))
    table, palette = left.image.table, left.image.palette
    s = palette_encoder.Settings(dithering="diffusion", shared=8, local=2)
    alone = palette_encoder._slots(rgba[:, 8:16], palette, left.image.selectors[1:2], table[1:2], s)
    assert (alone == left.image.indices[:, 8:16]).all()


# --------------------------------------------------------------------- windows
def test_checkpoints_add_up(spark):
    rows = [(i, (i * 37) % 11 + 1) for i in range(100)]
    out = prefix.checkpoint_offsets(spark.createDataFrame(rows, "n long, size long"), "size", "n", 16).orderBy("n").collect()
    assert [r["checkpoint"] + r["within"] for r in out] == [sum(s for _, s in rows[:i]) for i in range(100)]


def test_undominated_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (80, 2)))]
    got = {r["i"] for r in prefix.undominated(spark.createDataFrame(rows, "i int, cost int, error int"), "cost", "error").collect()}
    assert got == {i for i, a, b in rows if not any(x <= a and y <= b and (x < a or y < b) for _, x, y in rows)}


def test_bd_rate():
    curve = [(1.0, 30.0), (2.0, 33.0), (3.0, 35.5), (4.0, 37.0), (6.0, 39.5)]
    assert abs(reports.bd_rate_of(curve, curve)) < 1e-9
    assert abs(reports.bd_rate_of([(2 * r, q) for r, q in curve], curve) - 100) < 1e-6
    assert reports.bd_rate_of(curve[:3], curve) is None and reports.bd_rate_of(curve, [(r, q + 50) for r, q in curve]) is None


def test_quotas():
    weights = {"a": 100, "b": 45, "c": 55}
    assert sampling.quotas({"a": 900, "b": 900, "c": 900}, weights, 200) == {"a": 100, "b": 45, "c": 55}
    assert sampling.quotas({"a": 900, "b": 10, "c": 900}, weights, 200) == {"a": 118, "b": 10, "c": 72}
    assert sum(sampling.quotas({"a": 3, "b": 2, "c": 1}, weights, 50).values()) == 6


def brute_sweep(units, palette):
    modes = [1 if (u[3], u[2]) < (u[1], u[0]) else 0 for u in units]
    events = []
    for i, (b0, s0, b1, s1) in enumerate(units):
        now, other = ((b1, s1), (b0, s0)) if modes[i] else ((b0, s0), (b1, s1))
        if now[0] > other[0] and now[1] < other[1]:
            events.append(((other[1] - now[1]) / (now[0] - other[0]), i))
    out = []
    for step in range(len(events) + 1):
        if step:
            modes[sorted(events)[step - 1][1]] ^= 1
        n0, n1 = modes.count(0), modes.count(1)
        b0, b1 = (sum(u[2 * m] for u, k in zip(units, modes) if k == m) for m in (0, 1))
        sse = sum(u[1 + 2 * m] for u, m in zip(units, modes))
        size = (palette if n0 else 0) + (128 if n1 else 0) + (-(-len(units) // 8) if n0 and n1 else 0) + -(-b0 // 8) + -(-b1 // 8)
        out.append((step, sse, b0, b1, n0, n1, size))
    return out


def test_sweep_equals_the_flips_one_by_one(spark):
    rng = np.random.default_rng(8)
    for n in (1, 5, 17, 40):
        units = [tuple(int(v) for v in u) for u in rng.integers(1, 200, (n, 4))]
        df = spark.createDataFrame([(i, *u) for i, u in enumerate(units)], "unit int, bits0 long, sse0 long, bits1 long, sse1 long")
        states = transform.sweep(df, 96)
        want = brute_sweep(units, 96)
        assert sorted(tuple(r) for r in states.collect()) == want
        budget = sorted(w[6] for w in want)[len(want) // 2]
        best = transform.select_state(states, budget, ["step"]).first()
        inside = min((w for w in want if w[6] <= budget), key=lambda w: (w[1], w[6], w[0]))
        assert (best["step"], best["within_target"]) == (inside[0], True)
        assert transform.select_state(states, 0, ["step"]).first()["payload_bytes"] == min(w[6] for w in want)


def test_raises_on_bad_pixels(spark):
    good = spark.createDataFrame([(0, 0, 1, 2, 3, 255)], "y long, x long, r int, g int, b int, a int")
    assert pixels.checked(good, 1, 1).count() == 1
    with pytest.raises(Exception, match="pixel out of range"):
        pixels.checked(good.withColumn("r", F.lit(256)), 1, 1).collect()
    with pytest.raises(ValueError):
        pixels.center_crop(good, 4, 4, 8, 8)


def test_palettes_are_bounded(spark):
    with pytest.raises(ValueError):
        matching.palette_rows(spark.range(matching.MOST_ENTRIES + 1).select(F.col("id").alias("idx"), *[F.lit(0).alias(v) for v in "rgb"]))


def test_broadcasts_are_counted_first(spark):
    zeros = [F.lit(0).alias(v) for v in "rgb"]
    entries = lambda n: spark.range(n).select(F.col("id").alias("idx"), *zeros)
    colors = spark.createDataFrame([(1, 2, 3)], "r int, g int, b int")
    many = entries(matching.MOST_ENTRIES + 1)
    for refused in (lambda: matching.nearest_join(colors, many), lambda: matching.k_nearest(colors, many, 2), lambda: matching.distance_matrix(many)):
        with pytest.raises(ValueError, match="not broadcast"):
            refused()
    assert matching.nearest_join(colors, entries(matching.MOST_ENTRIES)).collect()[0]["idx"] == 0
    patterns = spark.createDataFrame([(0, [1, 0])], "block long, p array<int>")
    with pytest.raises(ValueError, match="not broadcast"):
        matching.hamming_nearest(patterns, spark.range(3).select(F.col("id").alias("proto"), F.array(F.lit(0), F.lit(0)).alias("q")), most=2)


def test_palettes_of_many_images_are_not_broadcast_by_force(spark):
    colors = spark.createDataFrame([(1, 9, 9, 9), (2, 0, 0, 0)], "pal int, r int, g int, b int")
    palette = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 8, 8, 8), (2, 0, 5, 5, 5)], "pal int, idx int, r int, g int, b int")
    out = matching.nearest_join(colors, palette, keys=("pal",))
    assert {(r["pal"], r["idx"], r["distance"]) for r in out.collect()} == {(1, 1, 3), (2, 0, 75)}
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in matching.decode_indexed(
        spark.createDataFrame([(0, 0)], "block int, slot int"), spark.createDataFrame([(0, 1, 0, 1)], "block int, pal int, slot int, idx int"), palette
    )._jdf.queryExecution().analyzed().toString()


# ----------------------------------------------------------------------- files
@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rgba = smooth(20, 24)
    e = palette_encoder.compress(rgba)
    (root / "wood").mkdir()
    (root / "wood" / "plank_color.ppm").write_bytes(containers.write_ppm(rgba[..., :3]))
    (root / "wood" / "plank_normal.pal").write_bytes(palette_file.encode(e.image))
    (root / "stone").mkdir()
    (root / "stone" / "wall.dct").write_bytes(dct_file.encode(rgba[..., :3], "1", coding=1))
    (root / "list.json").write_text('{"images": [{"id": "a", "path": "x", "class": "c"}, {"id": "b", "path": "y", "class": "c"}]}')
    log = ['{"imageId": "a", "profileId": "p", "width": 1}', '{"imageId": "b", "profileId": "p", "width": 2}', '{"imageId": "a", "profileId": "p", "width": 3}']
    (root / "log.jsonl").write_text("\n".join(log) + "\n")
    return root, rgba, e


def test_file_scans(spark, folder):
    root, rgba, e = folder
    images = tables.files(spark, str(root), "*.{ppm,pal,dct}")
    px = {}
    for r in tables.pixels(images).collect():
        px.setdefault(r["image_id"], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert set(px) == {"plank_color", "plank_normal", "wall"} and all(len(v) == 480 for v in px.values())
    assert all(px["plank_color"][y, x] == tuple(rgba[y, x, :3]) and px["plank_normal"][y, x] == tuple(e.pixels[y, x]) for y, x in px["wall"])
    points = spark.createDataFrame([("plank_normal", 3, 4), ("plank_normal", 23, 19)], "image_id string, x int, y int")
    got = tables.sample_points(images, points).collect()
    assert {(r["x"], r["y"], r["r"], r["g"], r["b"]) for r in got} == {(x, y, *map(int, e.pixels[y, x])) for x, y in ((3, 4), (23, 19))}
    units = tables.decode_units(tables.transform_units(images.where("image_id = 'wall'"))).collect()
    assert {((r["y"], r["x"]), (r["r"], r["g"], r["b"])) for r in units} == set(px["wall"].items())


def test_corpus_and_manifest(spark, folder):
    root = str(folder[0])
    found = {r["image_id"]: r["image_class"] for r in tables.corpus(spark, root, "*.{ppm,pal,dct}", {"color": "albedo", "normal": "normals"}, 3).collect()}
    assert found == {"plank_color": "albedo", "plank_normal": "normals", "wall": "stone"}
    with pytest.raises(ValueError):
        tables.corpus(spark, root, "*.ppm", {}, 2)
    assert tables.manifest(spark, f"{root}/wood", "*").first()["manifest"] == '{"default":"plank_color.ppm","files":["plank_color.ppm","plank_normal.pal"]}'
    assert [r["id"] for r in tables.image_list(spark, f"{root}/list.json", ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown id c"):
        tables.image_list(spark, f"{root}/list.json", ["c"])


def test_record_log_takes_the_last(spark, folder):
    rows = {r["imageId"]: r["width"] for r in tables.record_log(spark, f"{folder[0]}/log.jsonl").collect()}
    assert rows == {"a": 3, "b": 2}


def test_sinks(spark, folder, tmp_path):
    root, rgba, e = folder
    h, w = rgba.shape[:2]
    px = spark.createDataFrame([("i", y, x, *map(int, rgba[y, x])) for y in range(h) for x in range(w)], "image_id string, y long, x long, r long, g long, b long, a long")
    encoded = palette_encoder.encode_images(tables.packed(px))
    tables.write_files(encoded, str(tmp_path), ".pal")
    assert (palette_file.decode((tmp_path / "i.pal").read_bytes()).pixels() == e.pixels).all()
    tables.write_report(encoded.select("image_id", "mse"), str(tmp_path / "report"), ["image_id", "mse"])
    table = "".join(p.read_text() for p in (tmp_path / "report" / "markdown").glob("part-*"))
    assert table.startswith("| image_id | mse |\n| --- | --- |\n| i | ")


def test_mip_progression(spark):
    rows = [("a", 0, 20, 10, 8), ("a", 1, 10, 5, 4), ("a", 2, 5, 2, 2), ("b", 0, 8, 8, 8), ("b", 1, 4, 3, 4)]
    bad = tables.mip_progression(spark.createDataFrame(rows, "image_id string, mip int, width int, height int, block int")).collect()
    assert [(r["image_id"], r["mip"]) for r in bad] == [("b", 1)]


def test_workspace_keeps_its_result_only(spark):
    work = Workspace(spark, "t")
    first = work.save(spark.range(3), "first")
    out = work.result(first.selectExpr("id * 2 AS id"))
    assert sorted(r[0] for r in out.collect()) == [0, 2, 4]
    with pytest.raises(Exception):
        spark.read.parquet(first._tessella_path).count()


def test_palette_relations_join_back_to_pixels(spark, folder):
    root, rgba, e = folder
    rel = tables.palette_relations(tables.files(spark, str(root), "*.pal"))
    across = e.image.across
    px = rel["pixel_index"].withColumn("block", F.expr(f"y div {e.image.block} * {across} + x div {e.image.block}"))
    whole = px.join(rel["selector"], ["image_id", "block"]).join(rel["block_table"], ["image_id", "block", "slot"]).join(rel["palette"], ["image_id", "pal", "idx"])
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in whole.collect()}
    assert len(got) == 480 and all(got[y, x] == tuple(map(int, e.pixels[y, x])) for y, x in got)


def test_hybrid_budget_and_modes():
    from tessella.operators import hybrid_encoder
    from tessella.sources import hybrid_file

    rgba = np.concatenate([smooth(32, 32), np.kron(np.random.default_rng(3).integers(0, 2, (16, 16, 1)) * 255, np.ones((2, 2, 4))).astype(np.uint8)], axis=1)
    rgba[..., 3] = 255
    errors = {}
    for mode in ("palette", "transform", "auto"):
        image, state = hybrid_encoder.encode(rgba, 8.0, mode=mode)
        data = hybrid_file.encode(image)
        assert len(data) - hybrid_file.HEAD.size == state.payload_bytes <= 8 * 32 * 64 // 8
        px = hybrid_file.pixels(hybrid_file.decode(data))
        assert ((px.astype(int) - rgba[..., :3]) ** 2).sum() == state.sse
        errors[mode] = state.sse
    assert errors["auto"] <= min(errors["palette"], errors["transform"])
    blocks = hybrid_file.quantise(hybrid_file.transformed(rgba[..., :3]), hybrid_file.quality_tables(50))
    assert [[hybrid_file.block_bits(b) for b in u] for u in blocks] == hybrid_encoder.record_bits(blocks).tolist()
    with pytest.raises(ValueError):
        hybrid_encoder.encode(rgba, 0)


def test_settings_that_share_palettes_quantise_once(monkeypatch):
    rgba = np.random.default_rng(8).integers(0, 256, (24, 40, 4)).astype(np.uint8)
    calls, quantise = [], palette_encoder.quantise
    monkeypatch.setattr(palette_encoder, "quantise", lambda *a: (calls.append(1), quantise(*a))[1])
    for local, bits in ((4, 24), (8, 24), (8, 16)):
        palette_encoder.compress(rgba, palette_encoder.Settings(block=8, local=local, shared=32, palettes=2, color_bits=bits, passes=0))
    assert len(calls) == 2


def test_rate_differences_of_many_keys_are_those_one_by_one(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for k in range(120):
        sides = []
        for _ in "ab":
            m = int(rng.integers(0, 9)) if k % 3 else 6
            rates = np.sort(rng.choice([0, -1, *np.exp(rng.normal(0, 1, 40))], m))
            sides.append([(float(r), float(q)) for r, q in zip(rates, 30 + np.sort(rng.normal(5, 4, m)) + k % 2 * rng.normal(0, 2, m), strict=True)])
        want[k] = reports.bd_rate_of(*sides)
        rows += [(k, s, *p) for s, points in zip("ab", sides, strict=True) for p in points] + [(k, "c", 1.0, 1.0), (k, "a", 3.0, None)]
    curves = spark.createDataFrame(rows, "key long, side string, rate double, quality double")
    got = {r["key"]: r["bd_rate"] for r in reports.bd_rate(curves).collect()}
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 20
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-7, abs=1e-7))
    calls = reports.bd_rates_of(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), np.zeros(0), 2)
    assert np.isnan(calls).all()


def test_screening_is_by_the_rate_formula_in_many_tasks(spark, tmp_path):
    from tessella.operators import settings_search
    from tessella.plans import catalog

    spark.range(1, 400).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.settings_screen(spark, str(tmp_path)).rdd.getNumPartitions() > 1  # of one file with one split
    baseline = {"block": 4, "local": 16, "shared": 32, "palettes": 2, "bits": 24}
    found = settings_search.grid(baseline, [(8, 8, 64), (16, 2, 16)], (1, 16))
    sizes = spark.createDataFrame([(i, 10 + 7 * i, 33 + i) for i in range(9)], "image_id long, width long, height long")
    got = settings_search.screened(sizes, found, baseline, 3.0, 0.0, 1e9)
    formula = settings_search.rate_bits(*[F.col(k) for k in ("palettes", "shared", "bits", "block", "local", "width", "height")])
    rows = got.join(sizes, "image_id").select("payload_bits", formula.cast("long").alias("want"), "family", "palettes", "bits").collect()
    assert len(rows) == 9 * len(found) and all(r["payload_bits"] == r["want"] and r["family"] == ((r["palettes"], r["bits"]) == (2, 24)) for r in rows)


def test_direct_tables_are_not_broadcast(spark, tmp_path):
    from tessella.plans import catalog

    events = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), (F.col("id") / 9).alias("value"), F.timestamp_seconds("id").alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.direct_lookup_decode(spark, str(tmp_path))
    assert "SortMergeJoin [block" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 4000
