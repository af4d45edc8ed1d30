"""Rate-distortion reports over benchmark records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numeric import psnr
from tessella.operators.order_statistics import quantiles


def pooled_columns() -> list[Column]:
    """Aggregates of a group of records: rates over all pixels, PSNR of the pooled error, SSIM weighted by pixels."""
    pixels = F.sum("pixels")
    return [
        F.count("*").alias("images"),
        pixels.alias("pixels"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.sum("artifact_bytes").alias("artifact_bytes"),
        (F.sum("payload_bytes") * 8.0 / pixels).alias("payload_bpp"),
        (F.sum("artifact_bytes") * 8.0 / pixels).alias("file_bpp"),
        psnr(F.sum("squared_error") / F.sum("samples"), F.lit(None).cast("double")).alias("psnr"),
        (F.sum(F.col("ssim_milli") * F.col("pixels")) / pixels / 1000).alias("ssim"),
        F.sum("encode_us").alias("encode_us"),
        F.sum("decode_us").alias("decode_us"),
    ]


def pooled(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(*pooled_columns())


def pooled_special(records: DataFrame, *keys: str, step: float) -> DataFrame:
    """pooled with the errors of scalar and normal maps, which only some records have.

    scalar_error and scalar_samples give psnr_scalar; angle_sum, angle_count and
    angles, an array of counts in bins ``step`` wide, give the mean angle and the
    upper edge of the bin that holds the 95th percentile. Null without such records.
    """
    scalar = psnr(F.try_divide(F.sum("scalar_error"), F.sum("scalar_samples")), F.lit(None).cast("double"))
    angle = F.try_divide(F.sum("angle_sum"), F.sum("angle_count"))
    rows = records.groupBy(*keys).agg(*pooled_columns(), scalar.alias("psnr_scalar"), angle.alias("angle_mean"))
    bins = records.select(*keys, F.posexplode("angles").alias("bin", "n"))
    edges = histogram_percentile(bins, 0.95, step, *keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("edge").alias("angle_p95"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(edges, same, "left").drop(*[f"_{k}" for k in keys])


def pooled_levels(records: DataFrame) -> DataFrame:
    """pooled over all records, each dataset and each image class of one dataset, in one pass."""
    sets = [["profile_id"], ["profile_id", "dataset"], ["profile_id", "dataset", "image_class"]]
    return records.groupingSets(sets, "profile_id", "dataset", "image_class").agg(*pooled_columns())


def hybrid(records: DataFrame, *keys: str) -> DataFrame:
    """Plain means of quality and time, and how the units split between palette and transform."""
    palette, dct = F.sum("palette_units"), F.sum("dct_units")
    return records.groupBy(*keys).agg(
        F.count("*").alias("images"),
        (F.avg("ssim_milli") / 1000).alias("ssim_mean"),
        F.avg("encode_us").alias("encode_us_mean"),
        palette.alias("palette_units"),
        dct.alias("dct_units"),
        (F.try_divide(100.0 * palette, palette + dct)).alias("palette_percent"),
        F.count_if((F.col("palette_units") > 0) & (F.col("dct_units") > 0)).alias("mixed"),
        F.count_if(F.col("dct_units") == 0).alias("pure_palette"),
        F.count_if(F.col("palette_units") == 0).alias("pure_dct"),
    )


def mean_mse(records: DataFrame, *keys: str) -> DataFrame:
    """PSNR of the plain mean of the images' errors, which differs from pooling when sizes differ."""
    return records.groupBy(*keys).agg(psnr(F.avg(F.col("squared_error") / F.col("samples"))).alias("psnr"))


def histogram_percentile(bins: DataFrame, share: float, step: float, *keys: str) -> DataFrame:
    """Upper edge of the first bin at which the running count reaches ceil(share * count)."""
    summed = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    at = summed.withColumn("_run", running).withColumn("_need", F.ceil(total * share)).where("_run >= _need")
    return at.groupBy(*keys).agg(((F.min("bin") + 1) * step).alias("edge"))


def settings_distribution(df: DataFrame, profile: str, settings: list[tuple[str, str]]) -> DataFrame:
    """How often each formatted setting occurs for a profile; settings are (prefix, column) in order."""
    key = F.concat_ws("/", *[F.concat(F.lit(prefix), F.col(c).cast("string")) for prefix, c in settings])
    return df.groupBy(F.col(profile).alias("profile_id"), key.alias("settings")).agg(F.count("*").alias("n"))


def fallback_summary(df: DataFrame, targets: DataFrame, selected: str = "selected", dataset: str = "dataset") -> DataFrame:
    """For each dataset, the records whose selected rate is outside of their target's window (target, low, high)."""
    outside = (F.col(selected) < F.col("low") - 1e-9) | (F.col(selected) > F.col("high") + 1e-9)
    rows = df.join(targets, "target").withColumn("_out", outside)
    return rows.groupBy(dataset).agg(F.count("*").alias("searched"), F.count_if("_out").alias("outside"), F.min(F.when(F.col("_out"), F.col(selected))).alias("least"), F.max(F.when(F.col("_out"), F.col(selected))).alias("most"))


def storage_summary(df: DataFrame, fields: list[str], payload: str) -> DataFrame:
    """field, total, mean for each record and share of the payload in percent."""
    sums = df.agg(F.count("*").alias("_n"), F.sum(payload).alias("_p"), *[F.sum(f).alias(f) for f in fields])
    long = sums.select("_n", "_p", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in fields])).alias("e"))
    return long.select("e.field", "e.total", (F.col("e.total") / F.col("_n")).alias("mean"), (100.0 * F.col("e.total") / F.col("_p")).alias("percent"))


def packing_summary(df: DataFrame, legacy: str, packed: str, *keys: str) -> DataFrame:
    """Bytes before and after, saved and in percent, for each combination of ``keys``, and over all."""
    out = [F.sum(legacy).alias("legacy"), F.sum(packed).alias("packed"), (F.sum(legacy) - F.sum(packed)).alias("saved"), (100.0 * (F.sum(legacy) - F.sum(packed)) / F.sum(legacy)).alias("percent")]
    return df.rollup(*keys).agg(*out)


def stage_statistics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, least, median, p90, mean and population deviation; quantiles interpolate between order statistics, which are found by counts."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    at = quantiles(df, value, {"median": 0.5, "p90": 0.9}, *keys).drop("n")
    named = at.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = sums.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return both.select(*keys, "n", "least", "median", "p90", "mean", "deviation")


def wins(df: DataFrame, candidate: str, baseline: str, profile: str, keys: list[str], error: str) -> DataFrame:
    """On how many keys a profile has less error than another, of those where both exist."""
    side = lambda p, n: df.where(F.col(profile) == p).groupBy(*keys).agg(F.min(error).alias(n))
    return side(candidate, "_a").join(side(baseline, "_b"), keys).agg(F.count("*").alias("pairs"), F.count_if(F.col("_a") < F.col("_b")).alias("wins"))


def compare(aggregate: DataFrame, pairs: list[tuple[str, str]], profile: str, metrics: list[str]) -> DataFrame:
    """Differences of the metrics between named profiles; a pair with a missing side has no row."""
    rows = aggregate.sparkSession.createDataFrame(pairs, "left_id string, right_id string")
    a = aggregate.select(F.col(profile).alias("left_id"), *[F.col(m).alias(f"_a_{m}") for m in metrics])
    b = aggregate.select(F.col(profile).alias("right_id"), *[F.col(m).alias(f"_b_{m}") for m in metrics])
    return a.join(rows, "left_id").join(b, "right_id").select("left_id", "right_id", *[(F.col(f"_a_{m}") - F.col(f"_b_{m}")).alias(f"delta_{m}") for m in metrics])


def verified(df: DataFrame, stored: str, computed: Column, tolerance: float = 1e-12) -> DataFrame:
    """``df`` if every stored metric equals the one computed anew; the query fails otherwise."""
    wrong = F.abs(F.col(stored) - computed) > tolerance
    return df.withColumn(stored, F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit(f"{stored} differs"))).otherwise(F.col(stored)))


def bd_rate_of(first: list[tuple[float, float]], second: list[tuple[float, float]]) -> float | None:
    """Mean rate difference in percent of the first curve against the second, at equal quality.

    Curves are (rate, quality). Null with fewer than four points on the upper
    hull of either, or where their qualities do not overlap.
    """
    def hull(points: list[tuple[float, float]]) -> np.ndarray:
        kept: list[tuple[float, float]] = []
        for rate, quality in sorted(p for p in points if p[0] > 0 and p[1] is not None and p[1] == p[1]):
            if not kept or quality > kept[-1][1]:
                kept.append((rate, quality))
        return np.array(kept)

    a, b = hull(first), hull(second)
    if len(a) < 4 or len(b) < 4:
        return None
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 1].max(), b[:, 1].max())
    if high <= low:
        return None
    means = []
    for curve in (a, b):
        area = np.polyint(np.polyfit(curve[:, 1], np.log(curve[:, 0]), 3))
        means.append((np.polyval(area, high) - np.polyval(area, low)) / (high - low))
    return float(np.expm1(means[0] - means[1]) * 100)


def _hulls(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, log rate and quality of the points on the upper hull of each group, in rising order; ``frame`` has group, rate and quality."""
    usable = frame[(frame["rate"] > 0) & frame["quality"].notna()].sort_values(["group", "rate", "quality"])
    before = usable.groupby("group")["quality"].cummax().groupby(usable["group"]).shift()
    kept = usable[before.isna() | (usable["quality"] > before)]
    return kept["group"].to_numpy(), np.log(kept["rate"].to_numpy(dtype=np.float64)), kept["quality"].to_numpy(dtype=np.float64)


def bd_rates_of(group: np.ndarray, second: np.ndarray, rate: np.ndarray, quality: np.ndarray, n: int) -> np.ndarray:
    """``bd_rate_of`` for groups 0 to n - 1 at once, NaN where it has none; ``second`` tells the second curve's points.

    Curves with equally many points are fitted together, about the middle of the
    two curves' common qualities.
    """
    which, y, x = _hulls(pd.DataFrame({"group": group * 2 + second, "rate": rate, "quality": quality}))
    count = np.bincount(which, minlength=2 * n)
    start = np.cumsum(count) - count
    ends = np.full((2, 2 * n), np.nan)
    some = count > 0  # qualities rise along a hull
    ends[0, some], ends[1, some] = x[start[some]], x[(start + count - 1)[some]]
    low, high = ends[0].reshape(n, 2).max(axis=1), ends[1].reshape(n, 2).min(axis=1)
    fine = (count.reshape(n, 2) >= 4).all(axis=1) & (high > low)
    means = np.full(2 * n, np.nan)
    for points in np.unique(count[np.repeat(fine, 2)]):
        mine = np.flatnonzero((count == points) & np.repeat(fine, 2))
        at = start[mine][:, None] + np.arange(points)
        middle, half = ((high + low) / 2)[mine // 2][:, None], ((high - low) / 2)[mine // 2][:, None]
        t = (x[at] - middle) / half
        scale = np.abs(t).max(axis=1)
        t /= scale[:, None]
        q, r = np.linalg.qr(t[..., None] ** np.arange(4))
        fit = np.linalg.solve(r, q.swapaxes(1, 2) @ y[at][..., None])[..., 0]
        # over -1 to 1 the odd powers cancel; the mean of a square is a third
        means[mine] = fit[:, 0] + fit[:, 2] / (3 * scale**2)
    return np.expm1(means[0::2] - means[1::2]) * 100


def bd_rate(curves: DataFrame, key: str = "key") -> DataFrame:
    """bd_rate for each key of (key, side, rate, quality), side being 'a' or 'b'.

    A key's points come together as one row, so a task fits the curves of many keys at once.
    """
    point = F.struct((F.col("side") == "b").alias("b"), F.col("rate").cast("double").alias("rate"), F.col("quality").cast("double").alias("quality"))
    each = curves.groupBy(key).agg(F.collect_list(F.when(F.col("side").isin("a", "b"), point)).alias("points"))
    rows = each.select(key, F.transform("points", lambda p: p["b"]).alias("b"), F.transform("points", lambda p: p["rate"]).alias("rate"), F.transform("points", lambda p: p["quality"]).alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            group = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            b, rate, quality = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            found = bd_rates_of(group, b.astype(np.int64), rate.astype(np.float64), quality.astype(np.float64), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64(), from_pandas=True)], names=[key, "bd_rate"])

    return rows.mapInArrow(run, f"{key} {curves.schema[key].dataType.simpleString()}, bd_rate double")


#: Side of the squares of window places that one task works on at a time.
TILE = 64


def ssim(pairs: DataFrame, key: str = "image_id", tile: int = TILE) -> DataFrame:
    """Mean structural similarity of luma for each image, from pixels with r, g, b and r2, g2, b2 at (y, x).

    Windows of 11 by 11 pixels are dealt to tiles by their first pixel. A tile
    gets the ten lines and columns beyond it as well, so tiles are summed apart and
    an image of any size spreads over tasks. Images under 11 pixels in a direction
    have no value; an image must have a pixel at every place.
    """
    from tessella.functions.color import LUMA_709
    from tessella.operators.prefix import gaussian_taps

    taps = np.array(gaussian_taps(), dtype=np.float32)
    beyond = len(taps) - 1

    def smooth(x: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(x, len(taps), axis=1) @ taps
        return np.lib.stride_tricks.sliding_window_view(rows, len(taps), axis=0) @ taps

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = (pdf[c].to_numpy() - pdf[t].iloc[0] * tile for c, t in (("y", "_ty"), ("x", "_tx")))
        shape, total, n = (y.max() + 1, x.max() + 1), 0.0, 0
        if len(pdf) != shape[0] * shape[1]:
            raise ValueError("an image without some of its pixels")
        if min(shape) >= len(taps):
            a, b = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32)
            for plane, cs in ((a, ["r", "g", "b"]), (b, ["r2", "g2", "b2"])):
                plane[y, x] = pdf[cs].to_numpy(dtype=np.float32) @ np.array(LUMA_709, dtype=np.float32)
            ma, mb = smooth(a), smooth(b)
            va, vb, cov = np.maximum(smooth(a * a) - ma * ma, 0), np.maximum(smooth(b * b) - mb * mb, 0), smooth(a * b) - ma * mb
            c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
            total, n = float(value.sum(dtype=np.float64)), value.size
        return pd.DataFrame({key: [pdf[key].iloc[0]], "total": [total], "n": [n]})

    tiles = lambda v: F.sequence((F.greatest(F.lit(0), F.col(v) - beyond) / tile).cast("int"), (F.col(v) / tile).cast("int"))
    dealt = pairs.select(key, "y", "x", "r", "g", "b", "r2", "g2", "b2", F.explode(tiles("y")).alias("_ty")).select("*", F.explode(tiles("x")).alias("_tx"))
    sums = dealt.groupBy(key, "_ty", "_tx").applyInPandas(one, f"{key} {pairs.schema[key].dataType.simpleString()}, total double, n long")
    return sums.groupBy(key).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("ssim"))


def markdown(df: DataFrame, columns: list[str]) -> Iterator[str]:
    """Lines of a table of an aggregate, which must be small; for reports only."""
    yield "| " + " | ".join(columns) + " |"
    yield "| " + " | ".join("---" for _ in columns) + " |"
    for row in df.select(*columns).toLocalIterator():
        yield "| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) + " |"
