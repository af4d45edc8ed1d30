"""Whitening of vectors by a covariance that is computed in tiles.

The covariance of many dimensions fits no single task, so its entries are dealt
to tiles of dimension pairs. Rows are cut into blocks; the columns of a block that
belong to a tile's two dimension ranges travel to the task of that tile and row
block, are centred there and multiplied. Products are summed for each tile, first
in the task, then over all tasks, and the tiles are assembled on the driver, which
holds one matrix of at most ``MOST_DIMENSIONS`` squared and finds its eigenvectors.

Components are whole numbers, x = floor(1024 c) + 100000, so their sums are exact.

Nulls and odd cases: a vector that is null, holds a null or non-finite entry, or
is of another length than most of the remaining ones is left out; a zero vector
takes part. Null, repeated and equal ids, and repeated rows, are rows of their own.
A component without variance (its eigenvalue is not above 1e-12 of the largest) cannot be
whitened and is not returned, so a table of equal vectors, or of one, gives no
row, as an empty table does. A deviation that does not fit into 64 bits is null.
Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.vectors import finite, raw_matrix
from tessella.workspace import Workspace

#: Dimensions whose covariance the driver assembles: 128 MiB of doubles.
MOST_DIMENSIONS = 4096
SCALE, SHIFT = 1024, 100_000


def whole(c: np.ndarray) -> np.ndarray:
    """floor(1024 c) as doubles; the shift of 100000 is left to the sums, where it is exact."""
    return np.floor(c.astype(np.float64) * SCALE)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of a task's rows and the sum of each of their dimensions."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            part = whole(raw_matrix(batch.column(0))).astype(np.int64).sum(axis=0)
            n, total = n + batch.num_rows, part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total + n * SHIFT), pa.array(np.full(len(total), n))], names=["dim", "s", "n"])


def _column_blocks(tile: int, rows: int):
    """For each block of rows and each pair of dimension ranges, the columns of either range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            x = np.concatenate(held)
            for a in range(0, len(x), rows):
                parts = [np.ascontiguousarray(x[a : a + rows, t : t + tile]).tobytes() for t in range(0, x.shape[1], tile)]
                for i in range(len(parts)):
                    for j in range(i, len(parts)):
                        sides = [i] if i == j else [i, j]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array([v] * len(sides), pa.int32()) for v in (i, j)), pa.array([number] * len(sides), pa.int64()), pa.array(range(len(sides)), pa.int32()), pa.array([parts[s] for s in sides], pa.binary())],
                            names=["i", "j", "block", "side", "data"],
                        )
                number += 1
            held = []

        for batch in batches:
            if batch.num_rows:
                held.append(raw_matrix(batch.column(0)))
                if sum(map(len, held)) >= rows:
                    yield from out()
        if held:
            yield from out()

    return run


def _products(tile: int, mean: np.ndarray, kind: np.dtype):
    """Sums of products of centred columns for each tile; rows come sorted by tile, block and side."""
    width = lambda t: min(tile, len(mean) - t * tile)

    def centred(data: bytes, t: int) -> np.ndarray:
        return whole(np.frombuffer(data, dtype=kind).reshape(-1, width(t))) - mean[t * tile : t * tile + width(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, left = None, None, None
        for batch in batches:
            i, j, side = (batch.column(c).to_numpy() for c in (0, 1, 3))
            for k in range(batch.num_rows):
                if (i[k], j[k]) != at:
                    if at is not None:
                        yield _tile(*at, total)
                    at, total = (i[k], j[k]), np.zeros((width(i[k]), width(j[k])))
                x = centred(batch.column(4)[k].as_buffer(), j[k] if side[k] else i[k])
                if side[k] or i[k] == j[k]:
                    total += (left if side[k] else x).T @ x
                else:
                    left = x
        if at is not None:
            yield _tile(*at, total)

    return run


def _tile(i: int, j: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["i", "j", "m"])


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each tile; rows come sorted by tile."""
    at, total = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            key, m = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].values.to_numpy()
            if key != at:
                if at is not None:
                    yield _tile(*at, total)
                at, total = key, np.zeros(len(m))
            total = total + m
    if at is not None:
        yield _tile(*at, total)


def covariance(rows: DataFrame, mean: np.ndarray, n: int, tile: int = 32, block_rows: int = 2048) -> np.ndarray:
    """Covariance (divisor ``n``) of the whole numbers of column x of ``rows``, whose means less the shift are ``mean``."""
    kind = np.dtype(np.float32 if rows.schema["x"].dataType.elementType.typeName() == "float" else np.float64)
    binary = "i int, j int, block long, side int, data binary"
    sent = rows.mapInArrow(_column_blocks(tile, block_rows), binary).repartition("i", "j", "block").sortWithinPartitions("i", "j", "block", "side")
    tiles = sent.mapInArrow(_products(tile, mean, kind), "i int, j int, m array<double>")
    tiles = tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_tile_sums, "i int, j int, m array<double>")
    v = np.zeros((len(mean), len(mean)))
    for r in tiles.toLocalIterator():  # a row for each tile
        a, b = r["i"] * tile, r["j"] * tile
        m = np.array(r["m"]).reshape(min(tile, len(mean) - a), -1)
        v[a : a + m.shape[0], b : b + m.shape[1]] = m
        v[b : b + m.shape[1], a : a + m.shape[0]] = m.T
    return v / n


def eigenvectors(v: np.ndarray, most: int, least: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as rows, the largest entry of each above 0."""
    if not len(v):
        return np.zeros(0), v
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most].T
    some = values > least * max(values[0], 0)
    values, vectors = values[some], vectors[some]
    top = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(len(top)), top])[:, None]


def _deviation(y: np.ndarray, sums: np.ndarray, n: int) -> pa.Array:
    """Squared length of n x - S for each row, exact; null where it does not fit."""
    bound = int(np.abs(y).max(initial=0)) * n + int(np.abs(sums).max(initial=0))
    if bound * bound * y.shape[1] < 1 << 63:
        d = y.astype(np.int64) * n - sums
        return pa.array((d * d).sum(axis=1))
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _project(sums: np.ndarray, n: int, mean: np.ndarray, weights: np.ndarray):
    """``sums`` and ``mean`` are of the numbers without their shift, which both differences cancel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = whole(raw_matrix(batch.column(1)))
            w = (y - mean) @ weights.T
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _deviation(y, sums, n), lists], names=["vec_id", "deviation", "w"])

    return run


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of w less the identity, over all rows, centred before multiplying."""
    at = lambda i: F.get("w", F.lit(i))
    means = projected.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = projected.agg(*[F.avg((at(i) - F.lit(means[i])) * (at(j) - F.lit(means[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every remaining row and component."""
    spark = df.sparkSession
    work = Workspace(spark, "whiten")
    plain = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x")).where(finite("x"))
    common = plain.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = common["length"] if common else 0
    if length > MOST_DIMENSIONS:
        raise ValueError(f"covariances of more than {MOST_DIMENSIONS} dimensions are not assembled")
    rows = plain.where(F.size("x") == length)
    sums = rows.select("x").mapInArrow(_sums, "dim int, s long, n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect() if length else []
    n = sums[0]["n"] if sums else 0
    s = np.zeros(length, dtype=np.int64)
    for r in sums:  # a row for each dimension
        s[r["dim"]] = r["s"] - n * SHIFT
    mean = s / max(n, 1)
    v = covariance(rows.select("x"), mean, n, tile) if n else np.zeros((0, 0))
    values, vectors = eigenvectors(v, components)
    kind = df.schema[vec_id].dataType.simpleString()
    if not len(values):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    projected = work.save(rows.mapInArrow(_project(s, n, mean, vectors / np.sqrt(values)[:, None]), f"vec_id {kind}, deviation long, w array<double>"), "projected")
    explained = F.array(*[F.lit(float(e)) for e in values / np.trace(v)])
    error = identity_error(projected, len(values))
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened"))
    return each.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))
