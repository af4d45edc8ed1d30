"""Relations of pixels, blocks and benchmark records, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the derived image.
WIDTH = 100

PX_SQL = """px AS (
  SELECT event_id AS pos, event_id // 100 AS y, event_id % 100 AS x, CAST(round(value * 100) AS BIGINT) % 256 AS r, (user_id * 37) % 256 AS g,
    minute(ts) * 4 + CAST(floor(second(ts)) AS BIGINT) % 4 AS b, CASE WHEN event_id % 97 = 0 THEN 0 ELSE 255 END AS a
  FROM events)"""

BLK_SQL = """blk AS (
  SELECT vec_id, pos, pos % 8 AS u, pos // 8 AS v, s FROM (
    SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5) AS BIGINT) AS s FROM embeddings))"""

RECORDS_SQL = """records AS (
  SELECT l_orderkey AS image_id, l_returnflag || l_linestatus AS profile_id, l_returnflag AS dataset, l_linestatus AS image_class,
    CAST(l_quantity AS BIGINT) AS payload_bytes, CAST(l_quantity AS BIGINT) + 14 AS artifact_bytes, 16 + CAST(l_partkey % 240 AS BIGINT) AS pixels,
    (l_partkey * 7919) % 100003 AS squared_error, 3 * (16 + CAST(l_partkey % 240 AS BIGINT)) AS samples, (l_suppkey * 31) % 1000 AS ssim_milli,
    CAST(round(l_extendedprice) AS BIGINT) AS encode_us, CAST(round(l_discount * 1000) AS BIGINT) AS decode_us, (l_suppkey * 13) % 17 AS palette_units, (l_partkey * 11) % 13 AS dct_units
  FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, y, x, r, g, b, a of one image, ``WIDTH`` wide; every 97th pixel is transparent."""
    e = table(spark, sf_dir, "events")
    at = F.col("event_id")
    return e.select(
        at.alias("pos"),
        F.expr(f"event_id div {WIDTH}").alias("y"),
        (at % WIDTH).alias("x"),
        (F.round(F.col("value") * 100).cast("long") % 256).alias("r"),
        ((F.col("user_id") * 37) % 256).cast("long").alias("g"),
        (F.minute("ts") * 4 + F.second("ts") % 4).cast("long").alias("b"),
        F.when(at % 97 == 0, 0).otherwise(255).alias("a"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, pos, u, v, s: every vector as an 8x8 block of bytes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    s = F.floor((F.col("value").cast("double") + 1) * 127.5).cast("long")
    return e.select("vec_id", "pos", (F.col("pos") % 8).alias("u"), F.expr("pos div 8").alias("v"), s.alias("s"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark records, one per line item."""
    c = F.col
    whole = lambda name: c(name).cast("long")
    count = 16 + c("l_partkey") % 240
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("image_id"),
        F.concat("l_returnflag", "l_linestatus").alias("profile_id"),
        c("l_returnflag").alias("dataset"),
        c("l_linestatus").alias("image_class"),
        whole("l_quantity").alias("payload_bytes"),
        (whole("l_quantity") + 14).alias("artifact_bytes"),
        count.alias("pixels"),
        ((c("l_partkey") * 7919) % 100003).alias("squared_error"),
        (count * 3).alias("samples"),
        ((c("l_suppkey") * 31) % 1000).alias("ssim_milli"),
        F.round("l_extendedprice").cast("long").alias("encode_us"),
        F.round(c("l_discount") * 1000).cast("long").alias("decode_us"),
        ((c("l_suppkey") * 13) % 17).alias("palette_units"),
        ((c("l_partkey") * 11) % 13).alias("dct_units"),
    )
