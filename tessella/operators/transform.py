"""Block transforms and the choice between palette and transform for each coding unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.coding import BASIS_BITS, float_basis, integer_basis, zigzag
from tessella.functions.numeric import clamp, divide_signed, signed_golomb_bits, unsigned_golomb_bits
from tessella.operators import ranges
from tessella.workspace import Workspace


def rounded(x: np.ndarray, by: int | np.ndarray) -> np.ndarray:
    """Quotient of whole numbers to nearest, halves away from zero."""
    up = (2 * np.abs(x) + by) // (2 * np.asarray(by))
    return np.where(x < 0, -up, up)


def forward_fixed(s: np.ndarray) -> np.ndarray:
    """Integer transform of blocks (n, 8, 8) of bytes, rows first."""
    basis = integer_basis()
    rows = rounded((s.astype(np.int64) - 128) @ basis, 1 << BASIS_BITS)
    return rounded(np.einsum("nyu,yv->nvu", rows, basis), 1 << (BASIS_BITS + 2))


def inverse_fixed(f: np.ndarray) -> np.ndarray:
    """Blocks of samples, not yet clamped, from integer coefficients (n, 8, 8)."""
    basis = integer_basis()
    rows = rounded(np.einsum("nvu,xu->nvx", f.astype(np.int64), basis), 1 << BASIS_BITS)
    return rounded(np.einsum("nvx,yv->nyx", rows, basis), 1 << (BASIS_BITS + 2)) + 128


def forward_float(s: np.ndarray) -> np.ndarray:
    """Orthonormal transform of blocks (n, h, w)."""
    return float_basis(s.shape[1]) @ s @ float_basis(s.shape[2]).T


def inverse_float(f: np.ndarray) -> np.ndarray:
    return float_basis(f.shape[1]).T @ f @ float_basis(f.shape[2])


def mapped(df: DataFrame, values: str, out: str, kernel, kind: str = "bigint", shape: tuple[int, int] = (8, 8)) -> DataFrame:
    """Adds ``out``: a kernel over blocks (n, h, w) applied to an array column, batch by batch."""
    at = df.columns.index(values)
    element = pa.int64() if kind == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(n, *shape) if n else np.zeros((0, *shape))
            y = kernel(x).reshape(n, -1)
            flat = pa.array(y.ravel(), element)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (shape[0] * shape[1])), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<{kind}>")


def block_samples(vectors: DataFrame) -> DataFrame:
    """vec_id and s, the 64 bytes of each vector."""
    return vectors.select("vec_id", F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("long")).alias("s"))


def quantised(f: Column, table: list[int]) -> Column:
    """Coefficients over their table, as 16-bit numbers."""
    return F.zip_with(f, F.array(*map(F.lit, table)), lambda c, q: clamp(divide_signed(c, q), -32768, 32767).cast("long"))


def dequantised(q: Column, table: list[int]) -> Column:
    return F.zip_with(q, F.array(*map(F.lit, table)), lambda c, t: c * t)


def block_bits(q: Column) -> Column:
    """Bits of a block of quantised coefficients: the first one, then a run and a value for each that is not zero, and an end bit."""
    order = F.array(*map(F.lit, zigzag(8, 8)))
    along = F.transform(order, lambda p: F.get(q, p))
    start = F.struct(F.lit(0).cast("long").alias("run"), (signed_golomb_bits(F.get(q, F.lit(0))) + 1).cast("long").alias("bits"))

    def step(acc: Column, v: Column) -> Column:
        spent = acc["bits"] + 1 + unsigned_golomb_bits(acc["run"]) + signed_golomb_bits(v)
        return F.struct(F.when(v == 0, acc["run"] + 1).otherwise(F.lit(0)).cast("long").alias("run"), F.when(v == 0, acc["bits"]).otherwise(spent).cast("long").alias("bits"))

    return F.aggregate(along, start, step)["bits"]


def dct_candidates(vectors: DataFrame, qualities: dict[int, list[int]]) -> DataFrame:
    """quality, vec_id, bits and sse of each block at each quality (with its table)."""
    f = mapped(block_samples(vectors), "s", "f", forward_fixed)
    each = F.array(*[F.struct(F.lit(q).alias("quality"), quantised(F.col("f"), t).alias("q"), dequantised(quantised(F.col("f"), t), t).alias("d")) for q, t in qualities.items()])
    rows = f.select("vec_id", "s", F.explode(each).alias("e")).select("vec_id", "s", "e.quality", "e.q", "e.d")
    back = mapped(rows, "d", "r", lambda d: np.clip(inverse_fixed(d), 0, 255))
    error = F.aggregate(F.zip_with("s", "r", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda t, v: t + v)
    return back.select("quality", "vec_id", block_bits(F.col("q")).alias("bits"), error.alias("sse"))


def level_candidates(vectors: DataFrame, levels: int = 4) -> DataFrame:
    """vec_id, bits and sse of each block on a grid of grey levels between its least and greatest sample."""
    top = levels - 1
    b = block_samples(vectors).select("vec_id", "s", F.array_min("s").alias("lo"), F.array_max("s").alias("hi"))

    def error(v: Column) -> Column:
        span = F.col("hi") - F.col("lo")
        slot = F.when(span == 0, 0).otherwise(F.floor(((v - F.col("lo")) * top * 2 + span) / (span * 2)))
        back = F.col("lo") + F.floor((slot * span * 2 + top) / (top * 2))
        return ((v - back) * (v - back)).cast("long")

    sse = F.aggregate(F.transform("s", error), F.lit(0).cast("long"), lambda t, v: t + v)
    return b.select("vec_id", F.lit(2 * 8 + 64 * top.bit_length()).cast("long").alias("bits"), sse.alias("sse"))


def units(candidates: DataFrame, *keys: str) -> DataFrame:
    """Candidates of four consecutive blocks as one coding unit."""
    return candidates.groupBy(*keys, F.expr("vec_id div 4").alias("unit")).agg(F.sum("bits").alias("bits"), F.sum("sse").alias("sse"))


def sweep(candidates: DataFrame, palette_bytes: int, *keys: str, table_bytes: int = 128) -> DataFrame:
    """Every state of the sweep that trades error for bits, for each of ``keys``.

    Candidates are (keys, unit, bits0, sse0, bits1, sse1), mode 0 being palette
    and 1 transform. The sweep begins with the mode of least error in every unit
    and flips units in the order of error gained for each bit saved; where a unit
    has several rows, equal ones flip in the order of their changes. A state is
    the start plus a running sum of changes, so no loop is needed: flips are cut
    into ranges of that order, and each range carries on from the sums of those
    before, so the units of one key spread over many tasks. Returns step, sse,
    bits0, bits1, count0, count1 and payload_bytes.
    """
    candidates = Workspace(candidates.sparkSession, "sweep").save(candidates, "candidates")
    one = (F.col("sse1") < F.col("sse0")) | ((F.col("sse1") == F.col("sse0")) & (F.col("bits1") < F.col("bits0")))
    pick = lambda name, mode: F.when(F.col("mode") == mode, F.col(f"{name}{mode}")).otherwise(0)
    began = candidates.withColumn("mode", one.cast("int"))
    start = began.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(pick("sse", 0)) + F.sum(pick("sse", 1))).alias("_sse"), F.sum(pick("bits", 0)).alias("_b0"), F.sum(pick("bits", 1)).alias("_b1"), F.count_if(F.col("mode") == 0).alias("_c0"), F.count_if(F.col("mode") == 1).alias("_c1")
    )
    sign = F.when(F.col("mode") == 0, 1).otherwise(-1)  # of what moves to mode 1
    saved = F.when(F.col("mode") == 0, F.col("bits0") - F.col("bits1")).otherwise(F.col("bits1") - F.col("bits0"))
    lost = F.when(F.col("mode") == 0, F.col("sse1") - F.col("sse0")).otherwise(F.col("sse0") - F.col("sse1"))
    events = began.withColumn("_saved", saved).withColumn("_lost", lost).where("_saved > 0 and _lost > 0")
    events = events.select(*keys, "unit", (F.col("_lost") / F.col("_saved")).alias("_t"), F.col("_lost").alias("d_sse"), (-sign * F.col("bits0")).alias("d0"), (sign * F.col("bits1")).alias("d1"), sign.alias("d_count"))
    folds = {c: ("sum", f"_{c}") for c in ("step", "d_sse", "d0", "d1", "d_count")}
    each = events.select(*keys, "unit", "_t", F.lit(1).alias("_step"), *[F.col(c).alias(f"_{c}") for c in ("d_sse", "d0", "d1", "d_count")])
    # rows that share a unit and a threshold are told apart by what they change, so that every run gives the same states
    moved = ranges.running(each, folds, ["_t", "unit", "_d_sse", "_d0", "_d1", "_d_count"], *keys).select(*keys, *folds)
    zero = start.select(*keys, F.lit(0).cast("long").alias("step"), *[F.lit(0).cast("long").alias(c) for c in ("d_sse", "d0", "d1", "d_count")])
    states = moved.unionByName(zero).join(start, list(keys)) if keys else moved.unionByName(zero).crossJoin(F.broadcast(start))
    b0, b1, c0, c1 = F.col("_b0") + F.col("d0"), F.col("_b1") + F.col("d1"), F.col("_c0") - F.col("d_count"), F.col("_c1") + F.col("d_count")
    size = (
        F.when(c0 > 0, palette_bytes).otherwise(0) + F.when(c1 > 0, table_bytes).otherwise(0)
        + F.when((c0 > 0) & (c1 > 0), F.ceil(F.col("n") / 8)).otherwise(0) + F.ceil(b0 / 8) + F.ceil(b1 / 8)
    )
    return states.select(*keys, "step", (F.col("_sse") + F.col("d_sse")).alias("sse"), b0.alias("bits0"), b1.alias("bits1"), c0.alias("count0"), c1.alias("count1"), size.cast("long").alias("payload_bytes"))


def select_state(states: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The state of least error within the budget, then fewest bytes, then first in ``order``; else the smallest."""
    inside = F.col("payload_bytes") <= budget
    rank = F.struct((~inside).alias("over"), F.when(inside, F.col("sse")).otherwise(F.col("payload_bytes")).alias("a"), F.when(inside, F.col("payload_bytes")).otherwise(F.col("sse")).alias("b"), *order)
    best = F.min(F.struct(rank.alias("rank"), F.struct(*states.columns).alias("row")))
    return states.agg(best.alias("best")).select("best.row.*", (~F.col("best.rank.over")).alias("within_target"))
