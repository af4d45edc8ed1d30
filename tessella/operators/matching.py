"""Nearest-colour joins, indexed look-ups and dictionary matching.

One palette or dictionary is counted before it is broadcast, and refused beyond what
a file can hold; the palettes of many images grow with the data and are joined on
their keys. Pixels are reduced to distinct colours before they meet a palette.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries that a palette file can hold; a larger relation is no palette.
MOST_ENTRIES = 128 * 256


def small(rows: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """``rows`` to be broadcast, refused if there are more than ``most``."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are not broadcast")
    return F.broadcast(rows)


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


def city_distance(a: list[Column], b: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)), F.abs(a[0] - b[0]))


def palette_rows(palette: DataFrame) -> list[list[int]]:
    """Entries (r, g, b) of a palette in the order of idx, refused if there are more than a file can hold."""
    rows = palette.orderBy("idx").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError("too many palette entries")
    return [[r["r"], r["g"], r["b"]] for r in rows]


def nearest_index(r: Column, g: Column, b: Column, palette: list[list[float]], metric: str = "l2") -> Column:
    """Index of the nearest entry, the lowest on ties, as an expression without a join."""
    distance = city_distance if metric == "l1" else squared_distance
    entries = F.array(*[F.struct(distance([r, g, b], [F.lit(v) for v in e]).alias("d"), F.lit(i).alias("i")) for i, e in enumerate(palette)])
    return F.array_min(entries)["i"]


def nearest_join(colors: DataFrame, palette: DataFrame, metric: str = "l2", keys: tuple[str, ...] = ()) -> DataFrame:
    """idx and distance of the palette entry nearest to each distinct (r, g, b); lowest idx on ties.

    ``keys`` are equality keys of both sides, such as the palette that a colour's block uses.
    """
    named = palette.select(*keys, "idx", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    both = colors.join(named, list(keys)) if keys else colors.crossJoin(small(named))
    distance = (city_distance if metric == "l1" else squared_distance)([F.col(c) for c in "rgb"], [F.col(f"p{c}") for c in "rgb"])
    best = F.min(F.struct(distance.alias("d"), "idx"))
    return both.groupBy(*keys, "r", "g", "b").agg(best.alias("best")).select(*keys, "r", "g", "b", F.col("best.idx").alias("idx"), F.col("best.d").alias("distance"))


def k_nearest(colors: DataFrame, palette: DataFrame, k: int) -> DataFrame:
    """The k nearest entries of each distinct colour: rank, idx, distance, ordered by (distance, idx)."""
    both = colors.crossJoin(small(palette.select("idx", *[F.col(c).alias(f"p{c}") for c in "rgb"])))
    distance = squared_distance([F.col(c) for c in "rgb"], [F.col(f"p{c}") for c in "rgb"])
    ranked = both.groupBy("r", "g", "b").agg(F.slice(F.array_sort(F.collect_list(F.struct(distance.alias("distance"), "idx"))), 1, k).alias("near"))
    return ranked.select("r", "g", "b", F.posexplode("near").alias("p", "e")).select("r", "g", "b", (F.col("p") + 1).alias("rank"), "e.idx", "e.distance")


def assign(px: DataFrame, palette: DataFrame, metric: str = "l2", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with the idx of their nearest entry: distinct colours first, then back to the pixels."""
    known = nearest_join(px.select(*keys, "r", "g", "b").distinct(), palette, metric, keys)
    return px.join(known, [*keys, "r", "g", "b"])


def distance_matrix(palette: DataFrame, *keys: str) -> DataFrame:
    """i, j and squared distance of all pairs of entries, of one palette or within each of the palettes that ``keys`` name."""
    side = lambda n: palette.select(*keys, F.col("idx").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "rgb"])
    both = side("i").join(side("j"), list(keys)) if keys else side("i").crossJoin(small(side("j")))
    return both.select(*keys, "i", "j", squared_distance([F.col(f"i{c}") for c in "rgb"], [F.col(f"j{c}") for c in "rgb"]).alias("distance"))


def decode_indexed(indices: DataFrame, tables: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels of (block, slot) through the block's table (block, pal, slot, idx) and its palette (pal, idx, r, g, b)."""
    return indices.join(tables, ["block", "slot"]).join(palette, ["pal", "idx"])


def direct_slot(x: Column, y: Column, size: int) -> Column:
    """Slot of a pixel in a block whose table has an entry for each pixel."""
    return (y % size) * size + x % size


def hamming_nearest(patterns: DataFrame, prototypes: DataFrame, cutoff: int | None = None, most: int = 1 << 16) -> DataFrame:
    """For each pattern (block, p) the prototype (proto, q) with the fewest differing places; lowest proto on ties.

    A pattern whose least distance is above ``cutoff`` has no row; more than
    ``most`` prototypes are refused.
    """
    differing = F.aggregate(F.zip_with("p", "q", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + v)
    best = F.min(F.struct(differing.alias("d"), "proto"))
    out = patterns.crossJoin(small(prototypes, most)).groupBy("block").agg(best.alias("best")).select("block", F.col("best.proto").alias("proto"), F.col("best.d").alias("distance"))
    return out if cutoff is None else out.where(F.col("distance") <= cutoff)


# For each of the eight symmetries, whether the axes swap and whether x and y are then mirrored.
DIHEDRAL = ((0, 0, 0), (1, 0, 1), (0, 1, 1), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0), (1, 1, 1))


def dihedral(x: Column, y: Column, size: int, transform: int) -> tuple[Column, Column]:
    """Place in the prototype that (x, y) of a block shows under a symmetry of the square."""
    swap, mirror_x, mirror_y = DIHEDRAL[transform]
    u, v = (y, x) if swap else (x, y)
    return (size - 1 - u if mirror_x else u), (size - 1 - v if mirror_y else v)


def run_changes(values: DataFrame, *keys: str) -> DataFrame:
    """How often a value (v, in the order of pos) differs from the one before it, for each of ``keys``."""
    before = F.lag("v").over(Window.partitionBy(*keys).orderBy("pos"))
    return values.withColumn("_c", F.coalesce(F.col("v") != before, F.lit(False)).cast("long")).groupBy(*keys).agg(F.sum("_c").alias("changes"))
