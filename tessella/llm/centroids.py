"""Clustering by centroids, each vector meeting only those in its annulus.

A centroid nearer to a vector than some distance u has a norm within u of the
vector's (the triangle inequality with the origin). Centroids are kept in the order
of their norms; a first distance u comes from a few centroids of nearly the vector's norm,
and two binary searches then bound the ring of centroids that may be as near. They
are compared exactly, in whole numbers, those on the boundary included, so the
result is that of a comparison with all.

A round reads the stored vectors once and sums them by cluster in the task, so one
row for each cluster leaves it. Only the centroids, bounded by
``MOST_CENTROIDS``, are on the driver between rounds: a lost executor costs its own tasks.

Nulls and odd cases: vectors that are null, of another length, or hold null or
non-finite components are left out, so an empty table gives no row. Null and
repeated ids and repeated rows are rows of their own; a null id starts no
centroid, and where no id is left to start one there is no row. Rows of equal ids, whose hashes are equal, start in the order of their
vectors. Where fewer vectors than centroids are there, each starts one. A component
beyond 2^19 would put squared distances past 64 bits and is refused. Only the two
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.vectors import finite, matrix
from tessella.workspace import Workspace

#: Centroids that go with every task.
MOST_CENTROIDS = 1 << 16
#: Whole numbers below this keep squared distances of 64 dimensions within 62 bits.
MOST_COMPONENT = 1 << 27
#: Centroids next in norm from which a vector gets its first distance.
FIRST = 4
#: Whole numbers up to this, and the squares of their differences, are exact in doubles summed over 64 dimensions.
EXACT = 1 << 22


class Rings:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.argsort(norm, kind="stable")
        self.norm, self.c = norm[self.number], centroids[self.number]
        self.simple = bool(np.abs(centroids).max(initial=0) <= EXACT)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, the smaller number on ties, and how many were compared."""
        simple = self.simple and np.abs(x).max(initial=0) <= EXACT
        x, c = (x.astype(np.float64), self.c.astype(np.float64)) if simple else (x, self.c)
        k, rows = len(c), len(x)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        near = np.clip(np.searchsorted(self.norm, norm) - FIRST // 2, 0, max(0, k - FIRST))
        first = np.stack([((x - c[p]) ** 2).sum(axis=1) for p in (np.minimum(near + i, k - 1) for i in range(min(FIRST, k)))]).min(axis=0)
        reach = np.sqrt(first.astype(np.float64)) * (1 + 1e-9) + 1e-6 + norm * 1e-12
        low, high = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        best, number = np.full(rows, np.iinfo(np.int64).max), np.full(rows, k)
        for p in range(k):
            ring = np.nonzero((low <= p) & (p < high))[0]
            if not len(ring):
                continue
            d = ((x[ring] - c[p]) ** 2).sum(axis=1).astype(np.int64)
            better = (d < best[ring]) | ((d == best[ring]) & (self.number[p] < number[ring]))
            best[ring[better]], number[ring[better]] = d[better], self.number[p]
        return number, best, int((high - low).sum())


def _sums(centroids: np.ndarray):
    """Number and componentwise sums of a task's vectors of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, n, total = Rings(centroids), np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)).astype(np.int64)
                number = rings.nearest(x)[0]
                n += np.bincount(number, minlength=len(n))
                np.add.at(total, number, x)
        some = np.nonzero(n)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Rings(centroids)
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = rings.nearest(matrix(batch.column(1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean, as it was if it has none."""
    sums = kept.select("x").mapInArrow(_sums(centroids), "cluster int, n long, s array<long>")
    each = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in each.collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every vector kept."""
    if k > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids do not go with every task")
    spark = df.sparkSession
    work = Workspace(spark, "centroids")
    plain = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x")).where((F.size("x") == dimensions) & finite("x"))
    fits = F.forall("x", lambda v: F.abs(v) < MOST_COMPONENT / scale)
    sure = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit(f"a component is not below {MOST_COMPONENT // scale}")).cast(df.schema[embedding].dataType))
    kept = work.save(plain.select("vec_id", F.transform(sure, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("x")), "kept")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.where("vec_id is not null").orderBy(hashed, "x").limit(k).select("x").collect()  # k rows
    out = f"vec_id {df.schema[vec_id].dataType.simpleString()}, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in start], dtype=np.int64)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    assigned = work.save(kept.mapInArrow(_assign(centroids), out), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # a row for each centroid
    total = sum(r["d"] for r in sums)
    names = [(r["cluster"], r["d"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(told), "cluster")  # at most MOST_CENTROIDS rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
