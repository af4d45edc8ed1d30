"""As-of join of two relations of any size: each row with the last row of the other side up to its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranges


def asof_join(left: DataFrame, right: DataFrame, time: str, tie: str, *keys: str, within: float | None = None, forward: bool = False) -> DataFrame:
    """``left`` with ``match``, a struct of the columns of ``right`` besides ``keys``, of the last row of ``right`` at or before ``time``.

    Both sides become one relation in the order of (keys, time), cut into ranges, through
    which the last row of ``right`` is carried; so neither side is sent to all tasks, no
    pairs of rows are made, and a key with a third of all rows is cut like any other part of
    the order. ``tie`` orders rows of ``right`` of equal time, the greatest counts.
    With ``forward`` the first row at or after ``time`` counts, of equal time the
    one with the least ``tie``; ``time`` must then be a number. ``match`` is
    null if there is none, or if it is further than ``within`` away (seconds for timestamps).

    Rows with a null key or time stay and match nothing; such rows of ``right`` are no match.
    """
    rest = [c for c in right.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    known = right.where(F.col(time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    turn = (lambda v: -F.col(v)) if forward else F.col
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], turn(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), row.alias("_row"), F.lit(None).cast(known.select(F.struct(*rest)).schema[0].dataType).alias("_match"), F.monotonically_increasing_id().alias("_n"))
    b = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], turn(time).alias("_t"), F.lit(0).alias("_side"), turn(tie).alias("_tie"), F.lit(None).cast(left.select(row).schema[0].dataType).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_match"), F.monotonically_increasing_id().alias("_n"))
    own = [f"_k{i}" for i in range(len(keys))]
    carried = ranges.running(a.unionByName(b), {"_last": ("last", "_match")}, ["_t", "_side", "_tie", "_n"], *own)
    out = carried.where("_side = 1")
    usable = F.col("_t").isNotNull()
    for k in own:
        usable &= F.col(k).isNotNull()
    match = F.when(usable, F.col("_last"))
    if within is not None:
        seconds = (lambda v: v.cast("timestamp").cast("double")) if left.schema[time].dataType.typeName().startswith("timestamp") else (lambda v: v.cast("double"))
        match = F.when(F.abs(seconds(F.col("_row")[time]) - seconds(match[time])) <= within, match)
    return out.select("_row.*", match.alias("match"))
