"""Near-duplicate vectors by an exact metric range join.

Unit vectors are points of a space whose metric is the angle. Pivots divide it
into cells, each vector being at home with its nearest pivot. A vector is also
sent to every cell that may hold something within the angle sought: by the
triangle inequality, a cell can be left out if its pivot is further than the
cell's radius plus that angle, nearer than its least distance less that angle,
or further than the home pivot by more than twice that angle. Cells are then
joined independently, each home vector with all that its cell has received, so
that every vector's links are counted in full where it is at home.

Equal vectors are one row with a weight from the start. A cell is worked on in
blocks of home vectors, past which what the cell has received streams in
batches, so memory does not depend on the size of a cell. Only counts and a
spanning set of links leave a task.

Nulls and odd cases: a vector that is null, zero, holds a null or non-finite
component or has another length than most links with nothing; a null id takes
part in links and counts, and is larger than any other id in the choice of a
component's id; repeated rows link with each other; an empty table gives no row.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import hot_join
from tessella.llm.components import connected_components
from tessella.llm.vectors import matrix, usable
from tessella.workspace import Workspace

#: Home vectors of a block; vectors compared with a block at once.
BLOCK, BATCH = 4096, 1024


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _home(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _angles(units(matrix(batch.column(1))), pivots) if batch.num_rows else np.zeros((0, 1))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["id", "x", "w", "cell", "d"])

    return run


def _send(pivots: np.ndarray, nearest: np.ndarray, radius: np.ndarray, blocks: np.ndarray, angle: float, slack: float = 1e-7):
    """A row for each block of each cell that a vector may have links in; at home also as a home vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            d = _angles(units(matrix(batch.column(1))), pivots)
            reach = angle + slack
            sent = (d <= radius + reach) & (d >= nearest - reach) & (d <= d[np.arange(len(ids)), cells][:, None] + 2 * reach)
            sent[np.arange(len(ids)), cells] = True
            row, cell = np.nonzero(sent)
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            own = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            own = (own % blocks[cells].astype(np.uint64)).astype(np.int64)
            row, cell, block = np.concatenate([np.arange(len(ids)), row]), np.concatenate([cells, cell]), np.concatenate([own, block])
            guest = np.arange(len(row)) >= len(ids)
            for a in range(0, len(row), 8192):
                part = pa.array(row[a : a + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[a : a + 8192].astype(np.int32)), pa.array(block[a : a + 8192].astype(np.int32)), pa.array(guest[a : a + 8192]), *(batch.column(i).take(part) for i in range(3))],
                    names=["cell", "block", "guest", "id", "x", "w"],
                )

    return run


class Block:
    """The home vectors of one block, their link counts and what they are known to be connected with."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, least: float):
        self.ids, self.x, self.least = ids, x, least
        self.square, self.screen = (x**2).sum(axis=1), units(x).astype(np.float32)
        self.links, self.label = np.zeros(len(ids), dtype=np.int64), ids.copy()

    def meet(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts links with other vectors; returns links that connect all that these links connect.

        Single precision, well within its error, tells which vectors may have a
        link at all; these are compared in double precision.
        """
        near = self.screen @ units(x).astype(np.float32).T >= np.float32(self.least - 1e-4)
        near &= self.ids[:, None] != ids[None, :]
        rows, columns = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
        if not len(rows):
            return ids[:0], ids[:0]
        square = (x[columns] ** 2).sum(axis=1)
        part = self.x[rows] @ x[columns].T / np.sqrt(self.square[rows][:, None] * square[None, :]) >= self.least
        part &= self.ids[rows][:, None] != ids[columns][None, :]
        self.links[rows] += part @ w[columns]
        kept, held = part.any(axis=1), part.any(axis=0)
        if not kept.any():
            return ids[:0], ids[:0]
        rows, columns, part = rows[kept], columns[held], part[np.ix_(kept, held)]
        big = np.iinfo(np.int64).max
        left, right = self.label[rows], ids[columns]
        while True:
            new = np.minimum(right, np.where(part, left[:, None], big).min(axis=0))
            own = np.minimum(left, np.where(part, new[None, :], big).min(axis=1))
            if (own == left).all() and (new == right).all():
                break
            left, right = own, new
        moved = left != self.label[rows]
        self.label[rows] = left
        return np.concatenate([self.ids[rows][moved], ids[columns]]), np.concatenate([left[moved], right])


def _join(least: float):
    """Rows come sorted by cell and block, home vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, block = None, ([], []), None

        def out(a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, dtype=np.int64)) for v in (a, b)] + [pa.array(n, pa.int64())], names=["a", "b", "n"])

        def opened() -> Block:
            return Block(np.concatenate(homes[0]), np.concatenate(homes[1]), least)

        def counts(done: Block | None):
            if done is not None:
                yield out(done.ids, done.ids, done.links)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, x, w = batch.column(3).to_numpy(), matrix(batch.column(4)), batch.column(5).to_numpy()
            cuts = np.nonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(guest.astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if (cell[a], number[a]) != at:
                    yield from counts(block)
                    at, homes, block = (cell[a], number[a]), ([], []), None
                if not guest[a]:
                    homes[0].append(ids[a:b])
                    homes[1].append(x[a:b])
                    continue
                if block is None and homes[0]:
                    block = opened()
                for c in range(a, b, BATCH) if block is not None else ():
                    d = min(b, c + BATCH)
                    left, right = block.meet(ids[c:d], x[c:d], w[c:d])
                    keep = left != right
                    if keep.any():
                        yield out(left[keep], right[keep], [None] * int(keep.sum()))
        yield from counts(block)

    return run


def classes(df: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", cell_rows: int = 8192, most_pivots: int = 4096, seed: int = 29) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``df``.

    There is a pivot for each ``cell_rows`` distinct vectors, up to
    ``most_pivots``; beyond that cells grow, and are worked on in more blocks.
    """
    spark = df.sparkSession
    work = Workspace(spark, "rangejoin")
    plain = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x")).withColumn("ok", usable("x"))
    common = plain.where("ok").groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = common["length"] if common else 0
    rows = plain.withColumn("ok", F.col("ok") & (F.size("x") == length))
    kinds = rows.where("ok").groupBy("x").agg(F.min("vec_id").alias("head"), F.count("*").alias("w"))
    kinds = work.save(kinds.withColumn("id", F.monotonically_increasing_id()), "kinds")
    n = kinds.count()
    count = max(1, min(most_pivots, -(-n // cell_rows)))
    # pivots are bounded in number; they are the distinct vectors with the least hashes
    chosen = kinds.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(count).select("x").collect()
    pivots = units(np.array([r["x"] for r in chosen], dtype=np.float64)) if chosen else np.zeros((1, 1))
    homes = work.save(kinds.select("id", "x", "w").mapInArrow(_home(pivots), "id bigint, x array<float>, w bigint, cell int, d double".replace("array<float>", kinds.schema["x"].dataType.simpleString())), "homes")
    nearest, radius, blocks = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.ones(len(pivots), dtype=np.int64)
    for r in homes.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).collect():  # a row for each pivot
        nearest[r["cell"]], radius[r["cell"]], blocks[r["cell"]] = r["lo"], r["hi"], -(-r["n"] // BLOCK)
    kind = kinds.schema["x"].dataType.simpleString()
    sent = homes.mapInArrow(_send(pivots, nearest, radius, blocks, float(np.arccos(cosine))), f"cell int, block int, guest boolean, id bigint, x {kind}, w bigint")
    dealt = sent.repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")
    found = work.save(dealt.mapInArrow(_join(cosine), "a bigint, b bigint, n bigint"), "found")
    label = connected_components(work, found.where("n is null").select("a", "b"))
    named = kinds.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = work.save(named, "named")
    heads = work.save(named.groupBy("label").agg(F.min("head").alias("component"), F.count("*").alias("n")), "heads")
    links = found.where("n is not null").select(F.col("a").alias("id"), "n")
    told = hot_join(named, heads.drop("n"), ["label"], n, "inner", counts=heads.select("label", "n")).join(links, "id")
    told = work.save(told.select("x", (F.col("n") + F.col("w") - 1).alias("n_links"), F.col("component").alias("component_id")), "told")
    total = kinds.agg(F.sum("w")).first()[0] or 0
    joined = hot_join(rows.where("ok").select("vec_id", "x"), told, ["x"], total, "inner", counts=kinds.select("x", F.col("w").alias("n")))
    joined = joined.select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = joined.unionByName(alone)
    return work.result(both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
