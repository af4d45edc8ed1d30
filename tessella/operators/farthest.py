"""Representatives of a whole relation, each the one furthest from those before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessella.workspace import Workspace

#: Representatives after which the distances so far are stored, so that expressions stay short.
REFRESH = 16


def farthest_first(points: DataFrame, distance: Callable[[Row], Column], score: Callable[[Column], Column], first: Column, tie: Column, k: int) -> list[Row]:
    """Up to ``k`` rows of a stored relation, in the order in which they were chosen.

    The first is the one with the greatest ``first``; then each time the row with the
    greatest ``score`` of its distance to the nearest chosen row; on ties the least ``tie``.
    It ends early where no score is above 0. Each choice is one aggregate over the relation,
    which never moves; ``k`` bounds what is fetched.
    """
    if not k:
        return []
    work, row = Workspace(points.sparkSession, "farthest"), F.struct(*[F.col(c) for c in points.columns])
    start = points.select(F.max_by(row, F.struct(first, -tie)).alias("row")).first()["row"]
    chosen, fresh, known = [], start, points.withColumn("_near", F.lit(float("inf")))
    while fresh is not None:
        chosen.append(fresh)
        if len(chosen) == k:
            break
        since = chosen[(len(chosen) - 1) // REFRESH * REFRESH :]
        near = F.least("_near", *[distance(r) for r in since])
        if len(since) == REFRESH:
            known = work.save(known.withColumn("_near", near), "near")
            near = F.col("_near")
        worth = score(near)
        best = known.select(row.alias("row"), worth.alias("worth"), (-tie).alias("tie")).where("worth > 0")
        fresh = best.select(F.max_by("row", F.struct("worth", "tie")).alias("row")).first()["row"]
    return chosen
