"""Nearest neighbours by inner product, with a vantage-point tree for each shard.

The largest inner product is a nearest neighbour in Euclidean space once every
vector gets one more component that lifts it to a common length and every query
gets a zero there. In that space each shard of the index has a vantage-point
tree: a node splits its rows at the median distance to a vantage point and knows
the span of distances on both sides. A branch is left out if the triangle
inequality puts all of it further than the query's k-th best so far; ``factor``
multiplies the bound, so 1 gives the exact result and more prunes more.

A task holds one shard at a time, builds its tree once and lets all queries pass
by in blocks; the best k of each query are then merged over shards. Scores of
whole leaves are first found by a matrix product; those that may be among the
best are summed anew, component by component, so that equal vectors tie.

Nulls and odd cases: a vector that is null, zero, holds a null or non-finite
component or has another length than most takes no part, as query or as
candidate, nor does a null id; a query with fewer candidates than k gets all of
them; ties go to the smaller id; a row never finds itself, but repeated rows are
separate queries and candidates, so each finds its twin under their common id; an
empty table gives no row. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.vectors import matrix, usable
from tessella.workspace import Workspace

LEAF = 256
#: Pairs whose scores are summed at once.
PAIRS = 1 << 15


class Tree:
    """A vantage-point tree over the rows of ``x``; ties in distance are split by place, so depth is bounded."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.x, self.nodes = x, []
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][4 + side] = at
            if len(rows) <= leaf:
                self.nodes.append([None, None, None, rows, -1, -1])
                continue
            vantage = x[rows[rng.integers(len(rows))]]
            d = np.sqrt(((x[rows] - vantage) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            near, far = order[:half], order[half:]
            self.nodes.append([vantage, (d[near[0]], d[near[-1]]), (d[far[0]], d[far[-1]]), None, -1, -1])
            todo += [(rows[near], at, 0), (rows[far], at, 1)]


class Best:
    """The k best of each query so far: by score, then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of ``which`` and a column for each of ``ids``."""
        better = scores.max(axis=1, initial=-np.inf) >= self.score[which, -1]
        which, scores = which[better], scores[better]
        if not len(which):
            return
        s = np.concatenate([self.score[which], scores], axis=1)
        i = np.concatenate([self.id[which], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[which], self.id[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def search(tree: Tree, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, query_numbers: np.ndarray, best: Best, lift: float, factor: float) -> None:
    """Offers to ``best`` what the tree holds near the queries.

    vectors and queries are the original ones; numbers tell rows apart, ids are
    theirs to keep; lift is the common length. First every query goes straight
    down to one leaf, which gives it a first bound. Then the tree is walked once,
    with the queries that each branch may serve.
    """
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    square = (queries**2).sum(axis=1) + lift**2
    slack = 1e-9 * (1 + square)
    visited: dict[int, np.ndarray] = {}

    def scan(node: int, which: np.ndarray) -> None:
        rows = tree.nodes[node][3]
        if len(rows) and len(which):
            rough = queries[which] @ vectors[rows].T
            hopeful = rough >= (best.score[which, -1] - slack[which])[:, None]
            hopeful &= query_numbers[which][:, None] != numbers[rows][None, :]
            at, row = np.nonzero(hopeful)
            scores = np.full(rough.shape, -np.inf)
            for a in range(0, len(at), PAIRS):
                i, j = at[a : a + PAIRS], row[a : a + PAIRS]
                scores[i, j] = inner(queries[which[i]], vectors[rows[j]])
            best.offer(which, scores, ids[rows])

    def distance(which: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((lifted[which] - vantage) ** 2).sum(axis=1)))

    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, which = todo.pop()
        vantage, near, far, rows, left, right = tree.nodes[node]
        if rows is not None:
            scan(node, which)
            visited[node] = which
            continue
        closer = distance(which, vantage) <= (near[1] + far[0]) / 2
        todo += [(child, part) for child, part in ((left, which[closer]), (right, which[~closer])) if len(part)]
    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, which = todo.pop()
        vantage, near, far, rows, left, right = tree.nodes[node]
        if rows is not None:
            scan(node, np.setdiff1d(which, visited.get(node, which[:0])))
            continue
        d = distance(which, vantage)
        for child, (low, high) in ((left, near), (right, far)):
            bound = np.maximum(0, np.maximum(low - d, d - high)) * factor
            reach = square[which] - 2 * best.score[which, -1] + slack[which]
            part = which[bound**2 <= reach]
            if len(part):
                todo.append((child, part))


def _search_shards(k: int, lift: float, factor: float, block_rows: int):
    """Rows come sorted by shard, its candidates before the queries; one shard and one block of queries are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        rows: list[tuple] = []
        asked: list[tuple] = []

        def found() -> pa.RecordBatch:
            numbers, ids, x = (np.concatenate(c) for c in zip(*asked))
            best = Best(len(ids), k)
            search(*tree, x, numbers, best, lift, factor)
            at, rank = np.nonzero(best.score > -np.inf)
            asked.clear()
            columns = {"query": numbers[at], "query_id": ids[at], "vec_id": best.id[at, rank], "score": best.score[at, rank]}
            return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})

        def planted() -> tuple:
            numbers, ids, x = (np.concatenate(c) for c in zip(*rows))
            rows.clear()
            last = np.sqrt(np.maximum(0, lift**2 - (x**2).sum(axis=1)))
            return Tree(np.concatenate([x, last[:, None]], axis=1)), numbers, ids, x

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            numbers, ids, x = batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4))
            cuts = np.nonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if shards[a] != shard:
                    if asked and tree:
                        yield found()
                    shard, tree = shards[a], None
                    rows.clear()
                    asked.clear()
                (asked if asks[a] else rows).append((numbers[a:b], ids[a:b], x[a:b]))
                if asks[a]:
                    tree = tree or (planted() if rows else None)
                    if tree and sum(len(part[0]) for part in asked) >= block_rows:
                        yield found()
                    elif not tree:
                        asked.clear()
        if asked and tree:
            yield found()

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 65536, least_shards: int = 8, block_rows: int = 2048, seed: int = 17) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each query, nearest first.

    A shard holds about ``shard_rows`` rows, dealt by a hash of the row's number;
    small tables are cut into ``least_shards`` all the same, to keep tasks busy.
    Every query visits every shard, once, and sends on k rows from it at most.
    """
    work = Workspace(df.sparkSession, "vptrees")
    named = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("x"), is_query.alias("q")).where(F.col("id").isNotNull() & usable("x"))
    rows = work.save(named.select(F.monotonically_increasing_id().alias("n"), "id", F.transform("x", lambda v: v.cast("double")).alias("x"), F.coalesce("q", F.lit(False)).alias("q")), "rows")
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    facts = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "length").first()
    if facts is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == facts["length"])
    shards = max(min(least_shards, -(-facts["n"] // 4 // k)), -(-facts["n"] // shard_rows))
    lift = facts["top"] ** 0.5 * (1 + 1e-12)
    offered = rows.select(F.pmod(F.xxhash64(F.lit(seed), "n"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "n", "id", "x")
    asked = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "n", "id", "x")
    # more partitions than shards, so that few of them meet in one
    dealt = offered.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "asks", "n")
    found = dealt.mapInArrow(_search_shards(k, lift, factor, block_rows), "query bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
