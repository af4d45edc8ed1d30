"""A search in stages, each over what the stage before it left, that carries on after a stop.

A stage has a work list with a key, and scores its rows. Scored rows are stored in
slices of the key, so a stop loses one slice; begun again with the same folder, a
stage scores only what an anti-join with its stored rows leaves. Survivors are
chosen from the stored rows alone, so they are the same however often the search
was stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.workspace import Workspace

#: Slices of a work list, each stored as it is done.
SLICES = 4


class Stages:
    """Stored stages below one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or Workspace(spark, "search").root

    def _stored(self, name: str, schema: StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def scored(self, name: str, work: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame], slices: int = SLICES) -> DataFrame:
        """``score`` of every row of ``work``, whose ``keys`` it keeps; rows that an earlier run stored are not scored again.

        Of rows with equal keys one is scored. A row that ``score`` leaves out is
        tried again in the next run. Null keys are keys like any other.
        """
        distinct = work.dropDuplicates(keys)
        schema = score(distinct).schema
        for part in range(slices):
            done = self._stored(name, schema).select(*[F.col(k).alias(f"_{k}") for k in keys])
            mine = distinct.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == part)
            left = mine.join(done, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
            if left.limit(1).count():
                score(left).write.mode("append").parquet(f"{self.root}/{name}")
        return self._stored(name, schema)


def best_of(scored: DataFrame, group: str, order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each group, with their rank from 1; Spark cuts each partition's share before it moves."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def screened(stages: Stages, candidates: DataFrame, targets: list[float], score: Callable[[DataFrame], DataFrame], below: float = 0.25, keep: int = 12) -> DataFrame:
    """target, candidate, rate, error and rank: the best of the candidates whose rate is at most ``below`` under a target, scored on one source."""
    wanted = F.filter(F.array(*[F.lit(float(t)) for t in targets]), lambda t: (F.col("rate") <= t) & (F.col("rate") >= t - below))
    within = candidates.withColumn("targets", wanted).where(F.size("targets") > 0)
    scored = stages.scored("screen", within, ["candidate"], score)
    each = scored.select(F.explode("targets").alias("target"), "candidate", "rate", "error")
    return best_of(each, "target", [F.col("error"), F.desc("rate"), F.col("candidate")], keep)


def validated(stages: Stages, survivors: DataFrame, score: Callable[[DataFrame], DataFrame], top: int = 3) -> DataFrame:
    """target, candidate, rate, error and rank of each target's ``top`` survivors, each scored once on all sources."""
    chosen = survivors.where(F.col("rank") <= top).groupBy("candidate", "rate").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    scored = stages.scored("validate", chosen, ["candidate"], score)
    each = scored.select(F.explode("targets").alias("target"), "candidate", "rate", "error")
    return best_of(each, "target", [F.col("error"), F.desc("rate"), F.col("candidate")], top)


def with_policy(stages: Stages, winners: DataFrame, policies: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """target, candidate, policy, rate, error and rank: the best policy for each target's winner; ``policies`` is a short list."""
    work = winners.where(F.col("rank") == 1).select("target", "candidate", "rate").crossJoin(F.broadcast(policies.limit(1 << 10)))
    scored = stages.scored("policy", work, ["target", "candidate", "policy"], score)
    return best_of(scored.select("target", "candidate", "policy", "rate", "error"), "target", [F.col("error"), F.col("policy")], 1)
