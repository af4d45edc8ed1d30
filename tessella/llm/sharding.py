"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked. A row's fractional
rank, its place in its source as a share of the source, is the same for all
sources, so the rows sorted by it are interleaved in the corpus's own mixture.
This line is cut into shards whose row counts differ by one at most.

Nulls and odd cases: a null source is a source of its own, apart from the empty
name; null ids and texts are hashed as such; repeated rows each get a place of
their own; with fewer rows than shards some shards are empty; an empty table
gives no row. Columns of any name pass through; a column named shard or slot is
replaced by the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_row, bucket_bits, group_key, hash_bucket, running_sum
from tessella.workspace import Workspace


def assign_shards(df: DataFrame, source: str, key: list[str], shards: int = 16, seed: int = 11) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in each shard).

    ``key`` names the columns that the seeded shuffle hashes and that break ties.
    No step sorts a source or the corpus in one task: ranks come from bucket
    counts and from windows within a bucket of the hash or of the rank.
    """
    work = Workspace(df.sparkSession, "sharding")
    ties = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)])
    rows = work.save(df.select(as_row(df).alias("row"), F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]).alias("h"), group_key(source).alias("g"), ties.alias("k")), "hashed")
    total = rows.count()
    bits = bucket_bits(total)
    one = F.lit(1).cast("long")
    ranked = running_sum(rows.withColumn("b", hash_bucket("h", bits)), "g", "b", ["h", "k"], one, "rank")
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    placed = ranked.drop("b").join(counts, "g").withColumn("f", (F.col("rank") + 0.5) / F.col("n"))
    lined = placed.withColumn("all", F.lit(0)).withColumn("b", F.floor(F.col("f") * (1 << bits)))
    at = running_sum(lined, "all", "b", ["f", "g"], one, "at")
    shard = F.expr(f"at * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    cut = at.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("at") - first).cast("long"))
    return cut.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Writes each shard of ``df``, in the order of its slots, to its own folder under ``path``."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
