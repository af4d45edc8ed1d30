"""Running sums, ranks and curves along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import ranges
from tessella.operators.matching import small
from tessella.workspace import Workspace

#: Consecutive rows that one task sums, where a running sum goes over a whole relation.
SPAN = 1 << 16


def prefix_offsets(df: DataFrame, size: str, order: str, *keys: str, out: str = "offset") -> DataFrame:
    """Adds where each row's section begins: the sizes of the rows before it.

    Where ``order`` is a whole number, spans of it are summed first and only
    their sums are ordered over the whole of ``keys``, so that no task sorts it.
    """
    if df.schema[order].dataType.typeName() in ("integer", "long", "short"):
        split = checkpoint_offsets(df, size, order, SPAN, *keys)
        return split.withColumn(out, F.col("checkpoint") + F.col("within")).select(*df.columns, out)
    return _running(df, size, order, *keys, out=out)


def _running(df: DataFrame, size: str, order: str, *keys: str, out: str) -> DataFrame:
    return ranges.running(df, {out: ("sum", size)}, [order], *keys, inclusive=False)


def checkpoint_offsets(df: DataFrame, size: str, order: str, interval: int, *keys: str) -> DataFrame:
    """Adds checkpoint, the offset stored for the row's group of ``interval`` rows, and within, what comes before it there.

    ``order`` numbers the rows from 0. Groups are summed first, then spans of
    ``SPAN`` groups, so that no task orders all groups of ``keys``: spans are
    few, one for ``SPAN * interval`` rows.
    """
    grouped = df.withColumn("_group", F.floor(F.col(order) / interval))
    sums = grouped.groupBy(*keys, "_group").agg(F.sum(size).alias("_sum")).withColumn("_span", F.floor(F.col("_group") / SPAN))
    spans = sums.groupBy(*keys, "_span").agg(F.sum("_sum").alias("_total"))
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_total").over(before(keys or (F.lit(0),), "_span")), F.lit(0))).drop("_total")
    inside = F.coalesce(F.sum("_sum").over(before((*keys, "_span"), "_group")), F.lit(0))
    marks = sums.withColumn("_inside", inside).join(spans, [*keys, "_span"]).withColumn("checkpoint", F.col("_base") + F.col("_inside")).drop("_sum", "_span", "_base", "_inside")
    joined = grouped.join(marks, [*keys, "_group"])
    return joined.withColumn("within", F.coalesce(F.sum(size).over(before((*keys, "_group"), order)), F.lit(0))).drop("_group")


def rank_within(df: DataFrame, order: str, *keys: str, out: str = "ordinal") -> DataFrame:
    """Adds the number of rows of the same keys before this one."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def rate_curve(df: DataFrame, rate: str, quality: str, *keys: str) -> DataFrame:
    """Rows whose quality is above that of every row of lower rate, or of equal rate and lower quality.

    Of rows equal in rate and quality one stays. Rows without a quality or with a
    rate of 0 or less go.
    """
    usable = df.where((F.col(rate) > 0) & F.col(quality).isNotNull())
    return ranges.new_extremes(usable, quality, [rate, quality], *keys, least=False)


def undominated(df: DataFrame, cost: str, error: str) -> DataFrame:
    """Rows that no other row beats: at most as costly and as wrong, and less of one. Exact duplicates all stay.

    The least error for each cost is found first, so that a skyline over distinct
    costs, in ranges of them, stands for the rows; a row stays if it is on it.
    Rows with a null cost or error go.
    """
    known = df.where(F.col(cost).isNotNull() & F.col(error).isNotNull())
    at_cost = known.groupBy(cost).agg(F.min(error).alias(error))
    front = Workspace(df.sparkSession, "skyline").save(ranges.new_extremes(at_cost, error, [cost]), "front")
    few = front.limit(SPAN + 1).count() <= SPAN
    return known.join(F.broadcast(front) if few else front, [cost, error], "left_semi").select(*df.columns)


def brackets(points: DataFrame, rate: str, *keys: str) -> DataFrame:
    """Each point with the next one of higher rate, as next_<column>."""
    ahead = Window.partitionBy(*keys).orderBy(rate)
    return points.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in points.columns if c not in keys])


def interpolated(points: DataFrame, targets: DataFrame, rate: str, values: list[str], *keys: str, exact: float = 1e-12) -> DataFrame:
    """target and the values at it, linear in the logarithm of the rate; no row where the target lies outside the curve.

    A point within ``exact`` of the target is taken as it is. Targets are a
    short list, refused if it is not; each bracket looks up those that fall into it.
    """
    both = brackets(points, rate, *keys).join(small(targets), (F.abs(F.col(rate) - F.col("target")) < exact) | F.col("target").between(F.col(rate), F.col(f"next_{rate}")))
    hit = F.abs(F.col(rate) - F.col("target")) < exact
    share = (F.log2("target") - F.log2(rate)) / (F.log2(f"next_{rate}") - F.log2(rate))
    at = [F.when(hit, F.col(v)).otherwise(F.col(v) + share * (F.col(f"next_{v}") - F.col(v))).alias(v) for v in values]
    first = F.row_number().over(Window.partitionBy(*keys, "target").orderBy(F.when(hit, 0).otherwise(1), rate))
    return both.select(*keys, "target", *at, first.alias("_n")).where("_n = 1").drop("_n")


def midpoint_windows(targets: DataFrame) -> DataFrame:
    """target with low and high: halfway to its neighbours, the end ones mirrored, low not below 0. Targets are a short list."""
    listed = targets.agg(F.sort_array(F.collect_list("target")).alias("_all"))
    at = lambda i: F.get("_all", i)
    p, t = F.col("_p"), F.col("target")
    before, after = F.when(p > 0, at(p - 1)), at(p + 1)
    low = F.greatest(F.lit(0.0), (F.coalesce(before, t - (after - t)) + t) / 2)
    each = listed.select("_all", F.posexplode("_all").alias("_p", "target"))
    return each.select("target", low.alias("low"), ((F.coalesce(after, t + (t - before)) + t) / 2).alias("high"))


def gaussian_taps(radius: int = 5, sigma: float = 1.5) -> list[float]:
    """Weights of a normalised Gaussian window."""
    from math import exp

    raw = [exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_window(df: DataFrame, value: str, order: str, *keys: str, radius: int = 5, sigma: float = 1.5) -> DataFrame:
    """Adds smooth: the Gaussian mean about each row that has ``radius`` rows on both sides; other rows go."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = [F.lag(value, -i).over(w) if i <= 0 else F.lead(value, i).over(w) for i in range(-radius, radius + 1)]
    smooth: Column = F.lit(0.0)
    for k, v in zip(gaussian_taps(radius, sigma), near, strict=True):
        smooth = smooth + F.lit(k) * v
    return df.withColumn("smooth", smooth).where("smooth is not null")


def sliding_max(df: DataFrame, value: str, order: str, width: int, *keys: str) -> DataFrame:
    """Adds best: the largest of the ``width`` values before each row, null for the first."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, -1)
    return df.withColumn("best", F.max(value).over(near))
