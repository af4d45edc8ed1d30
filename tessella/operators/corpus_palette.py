"""One palette for all pixels of a corpus, by DataFrame steps.

Pixels count as distinct colours with weights, at most 2^24 of them whatever the corpus. A
round joins nothing: the centres, bounded by ``MOST_CENTRES``, are an expression over the
stored colours, whose sums by centre are partial aggregates. Coordinates and weights
are whole numbers, so sums and the choice on ties do not depend on the
order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.farthest import farthest_first
from tessella.operators.matching import nearest_index, squared_distance
from tessella.workspace import Workspace

#: Centres that an expression holds.
MOST_CENTRES = 256


def _rgb() -> list[Column]:
    return [F.col(c) for c in "rgb"]


def _to(values) -> Column:
    return squared_distance(_rgb(), [F.lit(v) for v in values])


def weighted_colors(px: DataFrame, order: str = "pos") -> DataFrame:
    """r, g, b, n and first, the least ``order``, of each distinct colour that is not transparent."""
    return px.where("a <> 0").groupBy("r", "g", "b").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def spread_centres(colors: DataFrame, k: int) -> list[list[float]]:
    """The heaviest colour, then each time the one with the greatest squared distance times weight, the first seen on ties."""
    rows = farthest_first(colors, lambda r: _to([r[c] for c in "rgb"]).cast("double"), lambda near: near * F.col("n"), F.col("n"), F.col("first"), k)
    return [[float(r[c]) for c in "rgb"] for r in rows]


def round_means(colors: DataFrame, centres: list[list[float]]) -> DataFrame:
    """slot, n and the weighted mean r, g, b of the colours nearest to each centre; a centre without colours has no row."""
    near = nearest_index(*_rgb(), centres)
    sums = colors.select(near.alias("slot"), "n", *_rgb()).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in "rgb"])
    return sums.select("slot", "n", *[(F.col(c) / F.col("n")).alias(c) for c in "rgb"])


def moved(colors: DataFrame, centres: list[list[float]]) -> list[list[float]]:
    """The centres after one round; one without colours stays."""
    new = list(centres)
    for r in round_means(colors, centres).collect():  # a row for each centre
        new[r["slot"]] = [r[c] for c in "rgb"]
    return new


def corpus_palette(px: DataFrame, k: int, rounds: int = 24, order: str = "pos") -> DataFrame:
    """r, g, b, n, slot and the palette colour pr, pg, pb of every distinct colour.

    Centres are moved to their weighted means until they stay or ``rounds`` are done. A
    palette colour is the member nearest to its centre, the heavier and then the
    first seen on ties; slots are numbered by falling weight. Fewer colours than
    ``k`` are their own palette; without an opaque pixel there is no row.
    """
    if not 1 <= k <= MOST_CENTRES:
        raise ValueError(f"between 1 and {MOST_CENTRES} centres")
    work = Workspace(px.sparkSession, "corpuspalette")
    colors = work.save(weighted_colors(px, order).withColumns({c: F.col(c).cast("long") for c in "rgb"}), "colors")
    centres = spread_centres(colors, k) if colors.limit(1).count() else [[0.0] * 3]
    for _ in range(rounds):
        new = moved(colors, centres)
        if new == centres:
            break
        centres = new
    at = F.array(*[F.array(*[F.lit(v) for v in row]) for row in centres])
    own = colors.withColumn("slot", nearest_index(*_rgb(), centres))
    off = squared_distance(_rgb(), [F.get(F.get(at, F.col("slot")), F.lit(i)) for i in range(3)])
    member = F.min_by(F.struct(*_rgb()), F.struct(F.round(off, 9), -F.col("n"), "first"))
    tops = own.groupBy("slot").agg(member.alias("p"), F.sum("n").alias("w")).collect()  # a row for each centre
    ranked = sorted(tops, key=lambda t: (-t["w"], t["slot"]))
    named = px.sparkSession.createDataFrame([(t["slot"], i, *(t["p"][c] for c in "rgb")) for i, t in enumerate(ranked)], "slot int, place int, pr long, pg long, pb long")
    return own.join(F.broadcast(named), "slot").select("r", "g", "b", "n", F.col("place").alias("slot"), "pr", "pg", "pb")  # at most MOST_CENTRES rows
