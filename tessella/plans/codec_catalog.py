"""Queries over codecs: encoding, files and random access, on images made of the pixel relation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tessella.operators import block_texture, hybrid_encoder, palette_encoder, reports, settings_bounds, settings_search
from tessella.operators.clustering import histogram, quantise
from tessella.plans.catalog import query
from tessella.plans.fixtures import PX_SQL, pixels, table
from tessella.sources import adaptive_file, dct_file, hybrid_file, mip_file, palette_file, pattern_file, tables
from tessella.streaming import records as streams
from tessella.workspace import Workspace

c = F.col

#: The pixel relation in bands of 40 lines, one image each.
BAND = 40
_IMG = f"WITH {PX_SQL}, img AS (SELECT CAST(y // {BAND} AS VARCHAR) AS image_id, count(*) AS pixels FROM px GROUP BY 1)"


def images(spark, sf_dir) -> DataFrame:
    """image_id, width, height, rgba."""
    p = pixels(spark, sf_dir).select((c("y") / BAND).cast("long").cast("string").alias("image_id"), (c("y") % BAND).alias("y"), "x", "r", "g", "b", "a")
    return tables.spread(tables.packed(p), "image_id")


def _per_image(df: DataFrame, schema: str, one) -> DataFrame:
    """A row of ``schema`` for each image from one(rgba array)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r["image_id"], *one(np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)

    return df.mapInArrow(run, schema)


def _quantised(method: str, space: str):
    def run(spark, sf_dir) -> DataFrame:
        def one(rgba):
            q = quantise(*histogram(rgba.reshape(-1, 4)), 16, method, space)
            d = (q.palette[q.slots].astype(np.int64) - q.colors) ** 2
            weights = histogram(rgba.reshape(-1, 4))[1]
            return len(q.palette), int(q.counts.sum()), q.iterations, round(float((d.sum(axis=1) * weights).sum() / weights.sum() / 3), 6)

        return _per_image(images(spark, sf_dir), "image_id string, colors bigint, pixels bigint, iterations bigint, mse double", one)

    run.__name__ = f"{method.replace('-', '_')}_{space}"
    return run


for _method in ("k-means", "k-medians", "k-medoids", "k-means-uniform"):
    query()(_quantised(_method, "rgb" if _method == "k-medians" else "oklab"))


@query()
def palette_encode(spark, sf_dir):
    """Whole encoder: clusters of blocks, palettes, tables, refinement and file."""
    e = palette_encoder.encode_images(images(spark, sf_dir), palette_encoder.Settings(palettes=4, shared=32))
    return e.select("image_id", F.length("data").alias("bytes"), F.round("mse", 6).alias("mse"), "passes")


def _encoded(rgba: np.ndarray, **settings) -> palette_encoder.Encoded:
    return palette_encoder.compress(rgba, palette_encoder.Settings(passes=0, space="rgb", method="k-means", **settings))


def _mismatches(sample, px: np.ndarray) -> int:
    """Places whose colour read alone differs from the decoded image."""
    return sum(tuple(map(int, px[y, x])) != tuple(sample(x, y)) for y in range(px.shape[0]) for x in range(px.shape[1]))


def _unit_mismatches(t: dct_file.Transformed, px: np.ndarray) -> int:
    """Pixels that differ where each unit is decoded alone, and places in every fifth line and column read alone.

    A place read alone decodes what its unit holds, so units are compared whole and places need not all be.
    Places are read unit by unit, so that the file decodes a unit for them once and not for each.
    """
    across, wrong = -(-px.shape[1] // 16), 0
    for k in range(across * -(-px.shape[0] // 16)):
        y, x = k // across * 16, k % across * 16
        part = px[y : y + 16, x : x + 16]
        wrong += int((t.unit(k).reshape(16, 16, 3)[: part.shape[0], : part.shape[1]] != part).any(axis=-1).sum())
        wrong += sum(tuple(part[v, u].tolist()) != t.sample(x + u, y + v) for v in range(-y % 5, part.shape[0], 5) for u in range(-x % 5, part.shape[1], 5))
    return wrong


# Images whose parts are given by formulas, so that SQL can look up every pixel: 2 palettes of 16 colours, tables of
# 4 entries, and as each pixel's slot its red byte modulo 4.
def _formed(rgba: np.ndarray, block: int = 8) -> palette_file.PaletteImage:
    height, width = rgba.shape[:2]
    p, i = np.meshgrid(np.arange(2), np.arange(16), indexing="ij")
    colors = np.stack([(i * 16 + p * 5) % 256, (i * 9 + p * 31) % 256, (255 - i * 5 - p * 40) % 256], axis=-1)
    blocks = np.arange(-(-width // block) * -(-height // block))
    table = (blocks[:, None] * 3 + np.arange(4)[None, :] * 5) % 16
    return palette_file.PaletteImage(width, height, block, colors, blocks % 2, table, rgba[..., 0].astype(np.int64) % 4)


def _formed_sql(size: str) -> str:
    """The double look-up of every pixel, for blocks of ``size``."""
    return f"""WITH {PX_SQL}, q AS (SELECT y // {BAND} AS image, y % {BAND} AS y, x, r % 4 AS slot FROM px),
sized AS (SELECT *, {size} AS size FROM q),
placed AS (SELECT *, (y // size) * ((100 + size - 1) // size) + x // size AS block FROM sized),
looked AS (SELECT *, block % 2 AS p, (block * 3 + slot * 5) % 16 AS i FROM placed)
SELECT CAST(image AS VARCHAR) AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((i * 16 + p * 5) % 256 AS INTEGER) AS r, CAST((i * 9 + p * 31) % 256 AS INTEGER) AS g, CAST((255 - i * 5 - p * 40) % 256 AS INTEGER) AS b FROM looked"""


def _scanned(write):
    """Pixels of the files that write(rgba) makes of each image, scanned as files of any kind are."""

    def run(spark, sf_dir) -> DataFrame:
        return tables.pixels(_per_image(images(spark, sf_dir), "image_id string, content binary", lambda rgba: (write(rgba),)))

    return run


def _tile_modes(rgba: np.ndarray) -> list[int]:
    return [k % 4 for k in range(-(-rgba.shape[1] // 64) * -(-rgba.shape[0] // 64))]


_WRITERS = {
    "palette_file_pixels": (lambda rgba: palette_file.encode(_formed(rgba)), "8"),
    "pattern_file_pixels": (lambda rgba: pattern_file.encode(_formed(rgba)), "8"),
    "smallest_file_pixels": (lambda rgba: pattern_file.encode_smallest(_formed(rgba)), "8"),
    "mip_file_pixels": (lambda rgba: mip_file.encode(_formed(rgba), mip_file.build(_formed(rgba))), "8"),
    # tiles of 64 take the block sizes 4, 8, 16 and 32 in turn; an image has two
    "adaptive_file_pixels": (lambda rgba: adaptive_file.encode([_formed(rgba, b) for b in adaptive_file.SIZES], _tile_modes(rgba)), "CASE WHEN x < 64 THEN 4 ELSE 8 END"),
}
for _name, (_write, _size) in _WRITERS.items():
    _run = _scanned(_write)
    _run.__name__ = _name
    query(_formed_sql(_size))(_run)


@query(_formed_sql("8") + " WHERE (x * 7 + y * 11) % 13 = 0")
def palette_file_points(spark, sf_dir):
    """Single pixels read by position from their own fields, without decoding the image."""
    files = _per_image(images(spark, sf_dir), "image_id string, content binary", lambda rgba: (palette_file.encode(_formed(rgba)),))
    p = pixels(spark, sf_dir).select((c("y") / BAND).cast("long").cast("string").alias("image_id"), "x", (c("y") % BAND).alias("y"))
    return tables.sample_points(files, p.where((c("x") * 7 + c("y") * 11) % 13 == 0))


@query(_IMG + " SELECT image_id, pixels, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS sampled_wrong FROM img")
def palette_file_roundtrip(spark, sf_dir):
    def one(rgba):
        e = _encoded(rgba, palettes=2, shared=16, local=4)
        data = palette_file.encode(e.image)
        px = palette_file.decode(data).pixels()
        return px.shape[0] * px.shape[1], int((px != e.pixels).sum()), _mismatches(lambda x, y: palette_file.sample(data, x, y), px)

    return _per_image(images(spark, sf_dir), "image_id string, pixels bigint, differing bigint, sampled_wrong bigint", one)


@query(_IMG + " SELECT image_id, pixels, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS sampled_wrong, true AS not_larger FROM img")
def pattern_file_roundtrip(spark, sf_dir):
    def one(rgba):
        e = _encoded(rgba, shared=16, local=2)
        data = pattern_file.encode(e.image)
        px, best = pattern_file.Patterned(data).image().pixels(), pattern_file.encode_smallest(e.image)
        return px.shape[0] * px.shape[1], int((px != e.pixels).sum()), _mismatches(pattern_file.sampler(data), px), len(best) <= len(palette_file.encode(e.image))

    return _per_image(images(spark, sf_dir), "image_id string, pixels bigint, differing bigint, sampled_wrong bigint, not_larger boolean", one)


@query(_IMG + " SELECT image_id, pixels, CAST(0 AS BIGINT) AS sampled_wrong FROM img")
def adaptive_file_roundtrip(spark, sf_dir):
    def one(rgba):
        found = [_encoded(rgba, block=b, shared=16, local=4).image for b in adaptive_file.SIZES]
        tiles = -(-rgba.shape[1] // 64) * -(-rgba.shape[0] // 64)
        a = adaptive_file.Adaptive(adaptive_file.encode(found, [k % 4 for k in range(tiles)]))
        return rgba.shape[0] * rgba.shape[1], _mismatches(a.sample, a.pixels())

    return _per_image(images(spark, sf_dir), "image_id string, pixels bigint, sampled_wrong bigint", one)


@query(_IMG + " SELECT image_id, pixels, CAST(0 AS BIGINT) AS differing, true AS halves FROM img")
def mip_file_roundtrip(spark, sf_dir):
    def one(rgba):
        e = _encoded(rgba, shared=16, local=4)
        levels = mip_file.build(e.image)
        base, back = mip_file.decode(mip_file.encode(e.image, levels))
        wrong = sum(int((mip_file.level_pixels(base, a) != mip_file.level_pixels(e.image, b)).sum()) for a, b in zip(back, levels, strict=True))
        return rgba.shape[0] * rgba.shape[1], wrong + int((base.pixels() != e.pixels).sum()), (back[-1].width, back[-1].height) == (1, 1)

    return _per_image(images(spark, sf_dir), "image_id string, pixels bigint, differing bigint, halves boolean", one)


@query(_IMG + " SELECT image_id, pixels, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS sampled_wrong, true AS no_worse FROM img")
def hybrid_file_roundtrip(spark, sf_dir):
    """Units take the mode of less error; the result is no worse than either mode alone."""

    def one(rgba):
        rgb = rgba[..., :3]
        p = _encoded(rgba, block=16, shared=32, local=8)
        t = hybrid_file.quality_tables(60)
        blocks = hybrid_file.quantise(hybrid_file.transformed(rgb), t)
        n = len(blocks)
        whole = [hybrid_file.pixels(hybrid_file.HybridImage(rgb.shape[1], rgb.shape[0], np.full(n, m), p.image, t, blocks)) for m in (0, 1)]
        at = np.arange(rgb.shape[0])[:, None] // 16 * -(-rgb.shape[1] // 16) + np.arange(rgb.shape[1])[None, :] // 16
        errors = [np.bincount(at.ravel(), ((w.astype(np.int64) - rgb) ** 2).sum(axis=2).ravel(), minlength=n) for w in whole]
        image = hybrid_file.HybridImage(rgb.shape[1], rgb.shape[0], (errors[1] < errors[0]).astype(np.int64), p.image, t, blocks)
        want, back = hybrid_file.pixels(image), hybrid_file.decode(hybrid_file.encode(image))
        px = hybrid_file.pixels(back)
        mixed = ((px.astype(np.int64) - rgb) ** 2).sum()
        return rgb.shape[0] * rgb.shape[1], int((px != want).sum()), _mismatches(lambda x, y: hybrid_file.sample(back, x, y), px), bool(mixed <= min(e.sum() for e in errors))

    return _per_image(images(spark, sf_dir), "image_id string, pixels bigint, differing bigint, sampled_wrong bigint, no_worse boolean", one)


@query(_IMG + ", p AS (SELECT unnest(['0.75', '2', '3', '6', '9']) AS preset) SELECT image_id, preset, CAST(0 AS BIGINT) AS sampled_wrong FROM img, p")
def transform_file_presets(spark, sf_dir):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rgb = np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4)[..., :3]
                t = dct_file.Transformed(dct_file.encode(rgb, r["preset"]))
                out.append(_unit_mismatches(t, t.pixels()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["image_id", "preset", "sampled_wrong"])

    presets = F.explode(F.array(*map(F.lit, ("0.75", "2", "3", "6", "9"))))
    each = images(spark, sf_dir).select("image_id", presets.alias("preset"), "width", "height", "rgba")
    return tables.spread(each, "image_id", "preset").mapInArrow(run, "image_id string, preset string, sampled_wrong bigint")


@query(_IMG + " SELECT image_id, pixels, true AS no_worse FROM img")
def transform_file_library(spark, sf_dir):
    """A prototype library reads back, and its search over allocations is no worse than the fixed one."""

    def one(rgba):
        rgb = rgba[..., :3]
        t = dct_file.Transformed(dct_file.encode(rgb, "2", library=4, library_kind=7))
        best, fixed = (dct_file.squared_error(rgb, d) for d in (dct_file.encode_best(rgb, "3"), dct_file.encode(rgb, "3")))
        px = t.pixels()
        return px.shape[0] * px.shape[1], bool(best <= fixed and px.shape == rgb.shape and not _unit_mismatches(t, px))

    return _per_image(images(spark, sf_dir), "image_id string, pixels bigint, no_worse boolean", one)


@query(f"WITH {PX_SQL} SELECT CAST(y // {BAND} AS VARCHAR) AS image_id, pos - (y // {BAND}) * {BAND * 100} AS pos, CAST(y % {BAND} AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CAST(a AS INTEGER) AS a FROM px")
def raw_file_scan(spark, sf_dir):
    """Headerless files: packed from pixels and scanned again, each with its own height."""
    return tables.raw_pixels(images(spark, sf_dir).select("image_id", "height", c("rgba").alias("content")), 100, c("height"))


@query(_IMG + " SELECT image_id, CAST(1.0 AS DOUBLE) AS same, true AS lower FROM img WHERE pixels >= 1100")
def ssim_luma(spark, sf_dir):
    """Similarity is 1 for the image itself and less for a coarser one."""
    p = pixels(spark, sf_dir).select((c("y") / BAND).cast("long").cast("string").alias("image_id"), (c("y") % BAND).alias("y"), "x", "r", "g", "b")
    pairs = lambda f: reports.ssim(p.select("*", *[f(c(v)).alias(f"{v}2") for v in "rgb"]))
    same, coarse = pairs(lambda v: v), pairs(lambda v: F.floor(v / 64) * 64)
    return same.where("ssim is not null").select("image_id", F.round("ssim", 6).alias("same")).join(coarse, "image_id").select("image_id", "same", (c("ssim") < 1).alias("lower"))


@query(_IMG + " SELECT image_id, true AS bc1_ok, true AS bc7_ok FROM img")
def block_textures(spark, sf_dir):
    """Decoded BC1 and BC7 are within their bounds: BC7 is no worse, and more effort never hurts BC1."""

    def one(rgba):
        b = block_texture.blocks_of(rgba)
        error = lambda d: int(((d[..., :3].astype(np.int64) - b[..., :3]) ** 2).sum())
        low, high = (error(block_texture.decode_bc1(block_texture.encode_bc1(b, e))) for e in ("fast", "thorough"))
        bc7 = error(block_texture.decode_bc7(block_texture.encode_bc7(np.concatenate([b[..., :3], np.full_like(b[..., :1], 255)], axis=-1))))
        return high <= low, bc7 <= high

    return _per_image(images(spark, sf_dir), "image_id string, bc1_ok boolean, bc7_ok boolean", one)


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_last_wins(spark, sf_dir):
    """The last record of each key, kept by a stream."""
    schema = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    stream = streams.record_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "parquet", "events.parquet")
    work = Workspace(spark, "stream")
    keys = ["user_id", "event_type"]
    return streams.run_to_table(streams.latest(stream.select(*schema.columns), keys, "event_id"), keys, f"{work.root}/latest", f"{work.root}/state").select(*schema.columns)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS records, CAST(sum(event_id % 97) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def stream_windowed_rates(spark, sf_dir):
    """Records and bytes for each hour and type, by a stream with a watermark."""
    e = table(spark, sf_dir, "events")
    stream = streams.record_stream(spark, sf_dir, e.schema, "parquet", "events.parquet")
    sized = stream.select(c("ts").cast("timestamp").alias("ts"), "event_type", (c("event_id") % 97).alias("bytes"), F.lit(1).alias("pixels"))
    work = Workspace(spark, "stream")
    rates = streams.windowed_rates(sized, "ts", "1 hour", "1 day", ["event_type"], "bytes", "pixels")
    out = streams.run_to_table(rates, ["start", "event_type"], f"{work.root}/rates", f"{work.root}/state")
    return out.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "records", "bytes")


@query()
def find_settings(spark, sf_dir):
    """Settings for each image: candidates screened by rate, the rest encoded or ruled out by bounds, the best guarded by the baseline's family."""
    baseline = {"block": 8, "local": 8, "shared": 64, "palettes": 1, "bits": 24}
    candidates = settings_search.grid(baseline, [(b, n, g) for b in (4, 8, 16, 32) for n in (2, 4, 8, 16) for g in (16, 32, 64, 128) if n <= g and n <= b * b], (1, 2, 4, 16))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                rgba = np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4)
                errors = settings_bounds.least_errors(rgba, r["tried"])
                tried = [{"image_id": r["image_id"], "width": r["width"], "height": r["height"], **t, "error": e} for t, e in zip(r["tried"], errors, strict=True) if e is not None]
                yield pa.RecordBatch.from_pylist(tried, to_arrow_schema(found))

    # an image's candidates are judged together, as the least error of some rules others out
    jobs = settings_search.shortlisted(images(spark, sf_dir), candidates, baseline, 4.0, 3.5, 4.5)
    found = StructType([*[jobs.schema[k] for k in ("image_id", "width", "height")], *jobs.schema["tried"].dataType.elementType.fields, StructField("error", LongType())])
    best = settings_search.choose(jobs.mapInArrow(run, found))
    rmse = F.sqrt(c("error") / (c("width") * c("height") * 3))
    return best.select("image_id", *settings_search.SETTINGS, "payload_bits", F.round("bpp", 6).alias("bpp"), F.round(rmse, 6).alias("rmse"), "guarded")


@query(_IMG + " SELECT image_id, true AS within, true AS same_size, true AS same_error FROM img")
def hybrid_encode(spark, sf_dir):
    """Encoding to six bits per pixel: the file is as large and as wrong as the chosen state says."""
    made = hybrid_encoder.encode_images(images(spark, sf_dir), 6.0)
    both = images(spark, sf_dir).join(made, "image_id")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rgb = np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4)[..., :3]
                px = hybrid_file.pixels(hybrid_file.decode(r["data"]))
                rows.append({"image_id": r["image_id"], "within": r["payload_bytes"] <= r["width"] * r["height"] * 6 // 8, "same_size": r["payload_bytes"] == len(r["data"]) - hybrid_file.HEAD.size, "same_error": int(((rgb.astype(np.int64) - px) ** 2).sum()) == r["sse"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.string()), ("within", pa.bool_()), ("same_size", pa.bool_()), ("same_error", pa.bool_())]))

    return both.mapInArrow(run, "image_id string, within boolean, same_size boolean, same_error boolean")
