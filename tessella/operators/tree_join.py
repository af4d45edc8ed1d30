"""Nearest entry of each point, both relations dealt to the cells of a k-d tree.

The tree comes from a hash-ordered sample of the entries, bounded by ``SAMPLE``,
and has at most ``MOST_CELLS`` cells; entries and points are both dealt to cells and meet there
by an equality join, so neither is sent to all tasks. The nearest entry of a point's
own cell bounds what can be nearer: the point then visits the cells whose box of entries lies
within that distance, found by descending the tree, ties included, and no others.

A cell's entries reach a task first and are held, its points then stream past them, so no
pair of rows is made. A cell with many points is split, each share meeting a copy of the
cell's entries, so a hot cell is no single task.

Nulls and odd cases: points and entries with a null coordinate take no part;
entries of equal place count once, with the least index; equal points count once. Without entries
there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.workspace import Workspace

#: Entries of a cell that the tree aims at, sampled entries for each cell, and cells at most.
LEAF, SAMPLE_EACH, MOST_CELLS = 64, 8, 1 << 14
#: Points of a cell that meet one copy of its entries; distances worked out at once.
SHARE, CHUNK = 1 << 12, 1 << 20


class Tree:
    """Splits of a complete binary tree as arrays, node n having children 2n and 2n + 1; leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            rows = parts.pop(node)
            for axis in np.argsort(-np.ptp(rows, axis=0), kind="stable") if len(rows) > 1 else ():
                values = np.unique(rows[:, axis])
                if len(values) > 1:
                    middle = np.median(rows[:, axis])
                    self.axis[node], self.at[node] = axis, values[max(1, np.searchsorted(values, middle, "left"))] if middle > values[0] else values[1]
                    break
            right = rows[:, self.axis[node]] >= self.at[node]
            parts[2 * node], parts[2 * node + 1] = rows[~right], rows[right]
        self.low = self.high = np.zeros((0, 0))

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node

    def bounded(self, boxes: dict[int, tuple[list, list]], dims: int) -> Tree:
        """Adds the boxes of the cells' entries, and of all nodes above; a cell without entries has an empty one."""
        self.low, self.high = np.full((2 << self.depth, dims), np.inf), np.full((2 << self.depth, dims), -np.inf)
        for cell, (low, high) in boxes.items():
            self.low[cell], self.high[cell] = low, high
        for node in range((1 << self.depth) - 1, 0, -1):
            self.low[node], self.high[node] = np.minimum(self.low[2 * node], self.low[2 * node + 1]), np.maximum(self.high[2 * node], self.high[2 * node + 1])
        return self

    def visits(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells whose box is no further than the row's squared distance ``near``, by descent from the root."""
        row, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            row, node = np.repeat(row, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            off = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0)
            within = (off**2).sum(axis=1) <= near[row] * (1 + 1e-12)
            row, node = row[within], node[within]
        return row, node


def _dealt(tree: Tree, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy().astype(np.float64) for i in range(dims)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cells(x))], names=[*batch.schema.names, "cell"])

    return run


def _visits(tree: Tree, dims: int):
    """Rows (coordinates, cell, distance, idx) once for every other cell to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = np.stack([batch.column(i).to_numpy().astype(np.float64) for i in range(dims)], axis=1)
                row, cell = tree.visits(x, batch.column(dims + 1).to_numpy(zero_copy_only=False).astype(np.float64))
                other = cell != batch.column(dims).to_numpy()[row]
                taken = pa.array(row[other])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in range(dims)), pa.array(cell[other])], names=[*batch.schema.names[:dims], "cell"])

    return run


def _nearest(dims: int, whole: bool):
    """The nearest entry of each point; rows come sorted by (cell, share), entries first. A cell without entries gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, share, point = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = np.stack([batch.column(4 + i).to_numpy().astype(np.int64 if whole else np.float64) for i in range(dims)], axis=1)
            idx = batch.column(3).fill_null(0).to_numpy()
            cuts = np.nonzero((np.diff(cell) != 0) | (np.diff(share) != 0) | (np.diff(point.astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if (cell[a], share[a]) != at:
                    at, held, ready = (cell[a], share[a]), [], None
                if not point[a]:
                    held.append((idx[a:b], x[a:b]))
                    continue
                if ready is None and held:
                    own, places = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    order = np.argsort(own, kind="stable")  # the first of equal distances has the lowest idx
                    ready = own[order], places[order]
                step = max(1, CHUNK // len(ready[0])) if ready else b - a
                for c in range(a, b, step):
                    mine = x[c : min(b, c + step)]
                    best, far = pa.nulls(len(mine), pa.int64()), pa.nulls(len(mine), pa.int64() if whole else pa.float64())
                    if ready:
                        d = sum((mine[:, None, k] - ready[1][None, :, k]) ** 2 for k in range(dims))
                        near = d.argmin(axis=1)
                        best, far = pa.array(ready[0][near]), pa.array(d[np.arange(len(mine)), near])
                    columns = [batch.column(4 + i).slice(c, len(mine)) for i in range(dims)]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column(0).slice(c, len(mine)), best, far], names=[*batch.schema.names[4:], "cell", "idx", "distance"])

    return run


def _met(points: DataFrame, homes: DataFrame, coordinates: list[str], whole: bool) -> DataFrame:
    """The stored points (coordinates, cell) with the idx and distance of the nearest entry of that cell, null where it has none."""
    large = points.groupBy("cell").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).where("shares > 1")  # at most a row for each cell
    shares = F.coalesce("shares", F.lit(1))
    mine = points.join(F.broadcast(large), "cell", "left").select("cell", F.pmod(F.xxhash64(*coordinates), shares).cast("int").alias("share"), F.lit(True).alias("point"), F.lit(None).cast("long").alias("idx"), *coordinates)
    copies = homes.join(F.broadcast(large), "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(False).alias("point"), F.col("idx").cast("long").alias("idx"), *coordinates)
    dealt = copies.unionByName(mine).repartition("cell", "share").sortWithinPartitions("cell", "share", "point")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*coordinates).schema.fields)
    return dealt.mapInArrow(_nearest(len(coordinates), whole), f"{kinds}, cell long, idx long, distance {'long' if whole else 'double'}")


def tree_nearest(points: DataFrame, entries: DataFrame, coordinates: list[str], leaf: int = LEAF, most_cells: int = MOST_CELLS) -> DataFrame:
    """Each distinct point with the idx and squared distance of its nearest entry (idx, coordinates), the lowest idx on ties."""
    work, dims = Workspace(points.sparkSession, "treejoin"), len(coordinates)
    there = lambda df: df.dropna(subset=coordinates)
    whole = all(df.schema[v].dataType.typeName() in ("byte", "short", "integer", "long") for df in (points, entries) for v in coordinates)
    cast = lambda df: df.withColumns({v: F.col(v).cast("long" if whole else "double") for v in coordinates})
    places = work.save(cast(there(entries)).groupBy(*coordinates).agg(F.min("idx").alias("idx")), "entries")
    count = places.count()
    depth = max(0, min(most_cells, -(-count // leaf)) - 1).bit_length()
    sampled = places.orderBy(F.xxhash64(*coordinates)).limit(SAMPLE_EACH << depth).select(*coordinates).collect()
    tree = Tree(np.array([list(r) for r in sampled], dtype=np.float64).reshape(-1, dims), depth)
    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    homes = work.save(places.mapInArrow(_dealt(tree, dims), f"{fields(places)}, cell long"), "homes")
    edges = homes.groupBy("cell").agg(*[f(v).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, v in enumerate(coordinates)])
    boxes = {r["cell"]: ([r[f"lo{i}"] for i in range(dims)], [r[f"hi{i}"] for i in range(dims)]) for r in edges.collect()}  # a row for each cell
    tree.bounded(boxes, dims)
    asked = cast(there(points).select(*coordinates)).distinct()
    kinds = fields(asked)
    asked = work.save(asked.mapInArrow(_dealt(tree, dims), f"{kinds}, cell long"), "points")
    first = work.save(_met(asked, homes, coordinates, whole), "first")
    near = first.select(*coordinates, "cell", F.coalesce(F.col("distance").cast("double"), F.lit(float("inf"))).alias("near"))
    visits = work.save(near.mapInArrow(_visits(tree, dims), f"{kinds}, cell long"), "visits")
    later = _met(visits, homes, coordinates, whole)
    both = first.unionByName(later).where("idx is not null").groupBy(*coordinates).agg(F.min(F.struct("distance", "idx")).alias("best"))
    return both.select(*coordinates, F.col("best.idx").alias("idx"), F.col("best.distance").alias("distance"))
