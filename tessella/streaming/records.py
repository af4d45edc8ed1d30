"""Record logs as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.sampling import last_wins


def record_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", pattern: str = "*", files_per_batch: int = 64) -> DataFrame:
    """Rows of matching files that appear in ``path``, a bounded number of files for each batch."""
    return spark.readStream.format(kind).schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)


def latest(stream: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row of each key so far, by ``order``; late rows never replace newer ones.

    State is one row for each key. Write it in update or complete mode.
    """
    return last_wins(stream, keys, order)


def windowed_rates(stream: DataFrame, time: str, size: str, late: str, keys: list[str], payload: str, pixels: str) -> DataFrame:
    """Records, bytes and bits per pixel for each window of event time and each of ``keys``; rows later than ``late`` are left out."""
    total = F.sum(payload)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, size), *keys)
        .agg(F.count("*").alias("records"), total.alias("bytes"), F.try_divide(total * 8.0, F.sum(pixels)).alias("bpp"))
        .select(F.col("window.start").alias("start"), *keys, "records", "bytes", "bpp")
    )


def run_to_table(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregated stream over all that is there now; the last row of each of ``keys``, as a table under ``path``.

    Executors write what each batch has changed to a folder of its own, which a
    repeated batch overwrites, so neither the driver nor a batch holds the result.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/_batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("_batch", "long")
    changes = stream.sparkSession.read.schema(schema).option("basePath", path).parquet(path)
    return last_wins(changes, keys, "_batch").select(*stream.columns)
