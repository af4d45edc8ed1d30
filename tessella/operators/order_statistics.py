"""Exact quantiles of each group by counts of value ranges.

Neither a sort of all values nor a map of all distinct ones is needed. A pass
counts the values of each group in ``PARTS`` equal parts between two bounds; the part that
holds a wanted rank becomes the new bounds, shrunk to its least and greatest
value, until it holds few values, or one value many times. Only the values of such
parts are then counted one by one. A pass leaves at most ``PARTS`` rows for each
pair of bounds, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.workspace import Workspace

#: Parts that a pass cuts a range of values into, and values that are looked at one by one.
PARTS, FEW = 1024, 20_000


def _same(keys: tuple[str, ...], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def selected(df: DataFrame, ranks: DataFrame, value: str, *keys: str, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """keys, rank and the value of that rank, counted from 0 in rising order, for each row of ``ranks`` (keys, rank).

    ``ranks`` must lie within their group's number of values; null and NaN values
    are not counted.
    """
    spark = df.sparkSession
    work = Workspace(spark, "orderstatistics")
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("inside")).withColumn("below", F.lit(0).cast("long"))
    wanted = ranks.alias("r").join(ends.alias("e"), _same(keys, "r", "e") or F.lit(True)).select(*[f"r.{k}" for k in keys], F.col("rank").cast("long").alias("rank"), "lo", "hi", "below", "inside")
    wanted = work.save(wanted, "wanted")
    wide = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    while wanted.where(wide).limit(1).count():
        bounds = wanted.where(wide).select(*keys, "lo", "hi", "below").distinct()
        within = rows.alias("x").join(bounds.alias("b"), [*_same(keys, "x", "b"), F.col("v").between(F.col("lo"), F.col("hi"))])
        part = F.least(F.lit(parts - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts)).cast("int")
        counts = within.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], "lo", "hi", "below", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy(*keys, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows
        counts = counts.withColumn("under", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        named = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n", "least", "most", "under")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi"), F.col("rank") >= F.col("under"), F.col("rank") < F.col("under") + F.col("n")]
        nearer = wanted.where(wide).join(named, same).select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("under").alias("below"), F.col("n").alias("inside"))
        wanted = work.save(wanted.where(~wide).unionByName(nearer), "wanted")
    bounds = wanted.select(*keys, "lo", "hi", "below").distinct()
    some = bounds.where("lo < hi")
    each = rows.alias("x").join(some.alias("b"), [*_same(keys, "x", "b"), F.col("v").between(F.col("lo"), F.col("hi"))]).groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], "lo", "hi", "below", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys, "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most `few` rows
    each = each.withColumn("upto", F.col("below") + F.sum("n").over(upto))
    named = each.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "v", "n", "upto")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi"), F.col("rank") < F.col("upto"), F.col("rank") >= F.col("upto") - F.col("n")]
    found = wanted.where("lo < hi").join(named, same).select(*keys, "rank", "v")
    return work.save(found.unionByName(wanted.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))), "found")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """A row for each group with its exact quantiles, named as in ``shares``, between order statistics by straight lines.

    A group without a value has no row; null and NaN values are left out.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")
    at = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    ranks = n.select(*keys, F.explode(F.array_distinct(F.array(*[f(at(s)).cast("long") for s in shares.values() for f in (F.floor, F.ceil)]))).alias("rank"))
    found = selected(df, ranks, value, *keys, few=few, parts=parts)
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_values"))  # two for each share
    both = n.alias("n").join(values.alias("f"), _same(keys, "n", "f") or F.lit(True))
    value_at = lambda p: F.col("_values")[p.cast("long")]
    out = []
    for name, share in shares.items():
        p = at(share)
        low, high = value_at(F.floor(p)), value_at(F.ceil(p))
        out.append((low + (high - low) * (p - F.floor(p))).alias(name))
    return both.select(*[F.col(f"n.{k}").alias(k) for k in keys], F.col("n.n").alias("n"), *out)
