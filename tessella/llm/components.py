"""Connected components of a graph given by its links, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.workspace import Workspace

#: Links in a file of a scratch table: few links are written to few files. So many at most are followed in one task.
ROWS = 50_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and the smallest node that it reaches, for the links (u, v) of all batches, which are at most ROWS."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, two = sorted((root(u), root(v)))
            up[two] = one
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "label"])


def connected_components(work: Workspace, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node that has a link, label being the smallest node reachable.

    Alternates two local rewrites until the links no longer change. In the large
    step, each node joins its larger neighbours to the smallest it knows; in the
    small step, its smaller neighbours and itself. Every step is a partial
    aggregation and a join that Spark may split, so a hub costs no single task.
    Once there are at most ``ROWS`` links, one task follows them to their ends.
    Links of a node with itself are ignored; repeated links count once.
    """
    x, y = F.col(a), F.col(b)
    now = work.save(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    seen = None
    while True:
        if now.count() <= ROWS:
            return work.save(now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_followed, "node long, label long"), "followed")
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u, 7))").alias("y")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parts = 1 + mark["n"] // ROWS
        large = work.save(large.coalesce(parts), "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.save(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct().coalesce(parts), "links")
        work.drop(large, now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
