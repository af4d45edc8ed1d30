"""All pairs of patterns within a Hamming distance, by equal blocks of bits.

If two patterns differ in at most d places and the places are cut into d + 1 blocks, one
block is equal. Patterns are dealt to buckets by (block, its bits), and only a
bucket's members are compared. A bucket with more than ``MOST`` members is not compared: its
members agree on its bits, so the same holds for the other places alone, and they
are dealt again by one of d + 1 blocks of those, together with the bits they share. No
bucket stays large, as distinct patterns end up with nothing else to agree on.

Nulls and odd cases: a null pattern, one with a null place, or one of more than 64
places, takes no part; equal patterns are one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.workspace import Workspace

#: Members of a bucket that are compared with each other.
MOST = 256


def word(bits: Column) -> Column:
    """An array of at most 64 zeros and ones as the bits of a long, the first the highest; null where it has a null or is longer."""
    whole = F.aggregate(bits, F.lit(0).cast("long"), lambda w, b: F.shiftleft(w, 1).bitwiseOR(b.cast("long")))
    return F.when(F.size(bits) <= 64, whole)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _blocks(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in ``parts`` blocks of nearly equal size, empty ones left out, each as a mask."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [bits[len(bits) * p // parts : len(bits) * (p + 1) // parts] for p in range(parts)]
    return [sum(1 << i for i in block) for block in cut if block]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pairs(words: DataFrame, distance: int, places: int = 64, most: int = MOST) -> DataFrame:
    """a < b and their distance, for all pairs of the distinct longs of column ``word`` that differ in at most ``distance`` of their places."""
    if most < 1 << min(distance, 62):
        raise ValueError("buckets must hold all patterns that differ in places outside of any block")
    work, parts = Workspace(words.sparkSession, "hamming"), distance + 1
    every = (1 << places) - 1
    dealt = [(m, words) for m in _blocks(every, parts)]
    found = None
    rows = None
    for mask, source in dealt:
        part = source.select("word", F.lit(_signed(mask)).alias("mask"), F.col("word").bitwiseAND(F.lit(_signed(mask))).alias("bits"))
        rows = part if rows is None else rows.unionByName(part)
    while True:
        rows = work.save(rows, "rows")
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("size")).where("size > 1")
        large = work.save(sizes.where(F.col("size") > most).select("mask", "bits"), "large")
        few = rows.join(sizes.where(F.col("size") <= most).select("mask", "bits"), ["mask", "bits"])
        few = work.save(few, "few")
        met = few.select("mask", "bits", F.col("word").alias("a")).join(few.select("mask", "bits", F.col("word").alias("b")), ["mask", "bits"])
        met = met.where(F.col("a") < F.col("b")).select("a", "b", differing(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance") <= distance)
        met = work.save(met, "pairs")
        found = met if found is None else found.unionByName(met)
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most (distance + 1) ** rounds
        if not masks:
            break
        split = F.lit(None).cast("array<bigint>")
        for mask in masks:
            own = mask & ((1 << 64) - 1)
            split = F.when(F.col("mask") == mask, F.array(*[F.lit(_signed(own | b)) for b in _blocks(every & ~own, parts)])).otherwise(split)
        again = rows.join(large, ["mask", "bits"]).select("word", F.explode(split).alias("mask"))
        rows = again.select("word", "mask", F.col("word").bitwiseAND(F.col("mask")).alias("bits")).distinct()
    return found.distinct()


def near_patterns(patterns: DataFrame, distance: int, places: int = 64, most: int = MOST) -> DataFrame:
    """id, head, n_near, nearest and partner for every row of ``patterns`` (id, p).

    ``head`` is the least id of an equal pattern; ``n_near`` counts the other rows within
    ``distance``; ``nearest`` is the least distance to another row, if it is within, and
    ``partner`` the least id of a row of another pattern at the least distance of such, if within.
    """
    work = Workspace(patterns.sparkSession, "nearpatterns")
    rows = work.save(patterns.select("id", word(F.col("p")).alias("word")), "rows")
    kinds = work.save(rows.where("word is not null").groupBy("word").agg(F.min("id").alias("head"), F.count("*").alias("n")), "kinds")
    links = work.save(pairs(kinds.select("word"), distance, places, most), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    other = kinds.select(F.col("word").alias("b"), F.col("head").alias("other"), F.col("n").alias("m"))
    met = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.sum("m").alias("m"), F.min(F.struct("distance", "other")).alias("best"))
    told = kinds.join(met, "word", "left").select("word", "head", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"), F.when(F.col("n") > 1, 0).otherwise(F.col("best.distance")).alias("nearest"), F.col("best.other").alias("partner"))
    return rows.join(told, "word", "left").select("id", "head", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "nearest", "partner")
