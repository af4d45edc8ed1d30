"""Filters and projections of pixel relations, and statistics of blocks of pixels.

A pixel relation has y, x, r, g, b and a, and pos where an order is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import color_key

CHANNELS = ("r", "g", "b")
# The ordered-dither matrices and their strength.
BAYER_2 = (0, 2, 3, 1)
BAYER_4 = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
BAYER_STRENGTH = 48


def checked(px: DataFrame, width: int, height: int) -> DataFrame:
    """``px`` if every pixel lies in the image and every channel is a byte; the query fails otherwise."""
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    for c in (*CHANNELS, "a"):
        inside &= F.col(c).between(0, 255)
    return px.withColumn("x", F.when(F.coalesce(inside, F.lit(False)), F.col("x")).otherwise(F.raise_error(F.lit("pixel out of range")).cast("long")))


def opaque(px: DataFrame) -> DataFrame:
    """Pixels that statistics and errors count: all but the fully transparent."""
    return px.where("a <> 0")


def with_block(px: DataFrame, size: int, width: int) -> DataFrame:
    """Adds block, numbered row by row."""
    across = -(-width // size)
    return px.withColumn("block", F.expr(f"(y div {size}) * {across} + x div {size}"))


def center_crop(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """The middle of the image, with its own coordinates."""
    if width < to_width or height < to_height:
        raise ValueError("the image is smaller than the crop")
    left, top = (width - to_width) // 2, (height - to_height) // 2
    kept = px.where(F.col("x").between(left, left + to_width - 1) & F.col("y").between(top, top + to_height - 1))
    return kept.withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def padded_tiles(px: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """block, ly, lx and the channels of every tile; tiles at the edge repeat their last pixels.

    Instead of joining a grid to the pixels, each border pixel makes its own
    copies, so the relation is not shuffled.
    """
    def spread(c: str, extent: int) -> Column:
        top = (extent + size - 1) // size * size - 1
        return F.sequence(F.col(c), F.when(F.col(c) == extent - 1, F.lit(top)).otherwise(F.col(c)).cast("long"))

    wide = px.withColumn("gx", F.explode(spread("x", width))).withColumn("gy", F.explode(spread("y", height)))
    across = -(-width // size)
    return wide.select(F.expr(f"(gy div {size}) * {across} + gx div {size}").alias("block"), (F.col("gy") % size).alias("ly"), (F.col("gx") % size).alias("lx"), *CHANNELS)


def block_pixel_count(block: Column, size: int, width: int, height: int) -> Column:
    """Pixels of a block that lie within the image."""
    across = -(-width // size)
    bx, by = block % across, F.floor(block / across)
    return F.least(F.lit(size), width - bx * size) * F.least(F.lit(size), height - by * size)


def histogram(px: DataFrame, *keys: str) -> DataFrame:
    """Colours with their count n and the place of their first pixel, for each of ``keys``."""
    return opaque(px).groupBy(*keys, color_key(*map(F.col, CHANNELS)).alias("rgb")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def block_descriptors(px: DataFrame, spread: float = 0.5) -> DataFrame:
    """Mean and scaled population deviation of each channel of each block, by sums of squares.

    ``spread`` scales the deviation: 0.5 or, for the other published encoder, 1.
    """
    out = []
    for c in CHANNELS:
        mean, square = F.avg(c), F.avg(F.col(c) * F.col(c))
        out += [mean.alias(f"mean_{c}"), (F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) * spread).alias(f"dev_{c}")]
    return opaque(px).groupBy("block").agg(*out)


def bayer_threshold(x: Column, y: Column, size: int) -> Column:
    """Offset that ordered dithering adds to each channel at (x, y)."""
    matrix = BAYER_2 if size == 2 else BAYER_4
    at = ((y % size) * size + x % size).cast("int")
    return ((F.get(F.array(*map(F.lit, matrix)), at) + 0.5) / len(matrix) - 0.5) * BAYER_STRENGTH


def systematic_sample(df: DataFrame, most: int, order: str, *keys: str) -> DataFrame:
    """Every k-th row in ``order``, k being the least that leaves at most ``most`` rows of each of ``keys``."""
    from tessella.operators.prefix import prefix_offsets

    ranked = prefix_offsets(df.withColumn("_one", F.lit(1)), "_one", order, *keys, out="_k")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = ranked.join(counts, list(keys)) if keys else ranked.crossJoin(F.broadcast(counts))
    return sized.where(F.col("_k") % F.ceil(F.col("_n") / most) == 0).select(*df.columns)


def squared_error(pairs: DataFrame, *keys: str) -> DataFrame:
    """sse and samples over pixels with channels r, g, b and r2, g2, b2."""
    error = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in CHANNELS[1:]), (F.col("r") - F.col("r2")) * (F.col("r") - F.col("r2")))
    return pairs.groupBy(*keys).agg(F.sum(error).alias("sse"), (F.count("*") * 3).alias("samples"))


def mip_levels(px: DataFrame, levels: int) -> DataFrame:
    """mip, y, x and mean linear r, g, b; level 0 is the image, each next one halves it by a box of 2 by 2."""
    from tessella.functions.color import srgb_to_linear

    now = px.select(F.lit(0).alias("mip"), "y", "x", *[srgb_to_linear(F.col(c)).alias(c) for c in CHANNELS])
    out = now
    for level in range(1, levels):
        now = now.groupBy(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[F.avg(c).alias(c) for c in CHANNELS]).select(F.lit(level).alias("mip"), "y", "x", *CHANNELS)
        out = out.unionByName(now)
    return out
