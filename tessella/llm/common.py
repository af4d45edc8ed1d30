"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def group_key(column: str) -> Column:
    """A never-null string key that tells null from the empty string."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(column)))


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it clash with no name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def bucket_bits(rows: int, per_bucket: int = 4_000) -> int:
    """Bits such that uniform hashes leave about ``per_bucket`` rows in a bucket."""
    return max(0, (max(1, rows) - 1) // per_bucket).bit_length()


def hash_bucket(hash_column: str, bits: int) -> Column:
    """The top ``bits`` of a signed 64-bit hash, in the order of the hash."""
    return F.shiftright(F.col(hash_column), 64 - bits) if bits else F.lit(0).cast("long")


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "left", share: int = 512, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of the never-null ``keys``.

    A key with more than 1/``share`` of ``total`` rows, the number of ``rows`` or
    more, is hot, so there are fewer than ``share`` hot keys, whatever the data.
    They are fetched, and their rows of ``table`` are broadcast; all other keys
    meet by shuffle, none of them large. ``rows`` should be a stored table, as it
    is read for both parts. ``counts`` may give the keys' numbers of rows (keys,
    n), if they are known. The columns are those of ``rows``, then the others of
    ``table``.
    """
    counts = counts if counts is not None else rows.groupBy(*keys).agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") * share > total).select(*keys)
    found = over.limit(share).collect()  # there are fewer
    if not found:
        return rows.join(table, keys, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, over.schema))
    cold = rows.join(hot, keys, "left_anti").join(table, keys, how)
    return rows.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how).unionByName(cold)


def running_sum(df: DataFrame, group: str, bucket: str, order: list, size: Column, out: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows before this one in its group.

    Works in three levels so that no task holds a whole group: rows are summed by
    bucket and by span of 4,096 buckets, running sums are taken over the spans of
    a group, then over the buckets of a span, and only rows of one bucket are
    sorted together. ``bucket`` is a long and must not fall along ``order``.
    """
    sized = df.withColumn("_size", size)
    before = Window.unboundedPreceding, -1
    sums = sized.groupBy(group, bucket).agg(F.sum("_size").alias("_sum")).withColumn("_span", F.shiftright(F.col(bucket), 12))
    spans = sums.groupBy(F.col(group).alias("_span_group"), F.col("_span").alias("_span_no")).agg(F.sum("_sum").alias("_span_sum"))
    starts = spans.withColumn("_start", F.coalesce(F.sum("_span_sum").over(Window.partitionBy("_span_group").orderBy("_span_no").rowsBetween(*before)), F.lit(0)))
    within = F.coalesce(F.sum("_sum").over(Window.partitionBy(group, "_span").orderBy(bucket).rowsBetween(*before)), F.lit(0))
    bases = sums.withColumn("_within", within).join(starts, (F.col(group) == F.col("_span_group")) & (F.col("_span") == F.col("_span_no")))
    bases = bases.select(F.col(group).alias("_sum_group"), F.col(bucket).alias("_sum_bucket"), (F.col("_start") + F.col("_within")).alias("_base"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(*before)
    joined = sized.join(bases, (F.col(group) == F.col("_sum_group")) & (F.col(bucket) == F.col("_sum_bucket")))
    total = F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return joined.withColumn(out, total.cast("long")).drop("_sum_group", "_sum_bucket", "_base", "_size")


def permuted(x: Column, n: Column, key: Column, rounds: int = 24) -> Column:
    """A keyed pseudorandom permutation of 0..n-1, as an expression of the index.

    The swap-or-not construction: in each round the index may change places with
    its mirror image about a keyed point, decided by a hash of the larger of the
    two. It is a bijection for every n, so it needs no cycle walking. ``x`` and
    ``n`` are longs, n at least 1.
    """

    def step(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        swap = F.pmod(F.xxhash64(key, r + rounds, F.greatest(at, mirror)), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)
