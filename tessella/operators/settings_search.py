"""Search for palette settings: rates by formula first, encodings of what is left, and a guard for the baseline's family."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Names of settings: block size, local and shared colours, palettes, bits of a stored colour.
SETTINGS = ("block", "local", "shared", "palettes", "bits")


def rate_bits(p, g, bits, b, l, width, height):  # noqa: E741
    """Payload bits of a palette image: palettes, selectors, block tables and, unless direct, pixel indices."""
    blocks = F.ceil(width / b) * F.ceil(height / b)
    lg = lambda v: F.length(F.bin(v)) - 1
    return p * g * bits + blocks * lg(p) + blocks * l * lg(g) + F.when(l == b * b, 0).otherwise(width * height * lg(l))


def rate_guard(error, bpp, base_error, base_bpp, penalty: float = 15.0) -> Column:
    """Whether a candidate's gain in decibels pays for its rate against a baseline."""
    pays = 10 * F.log10(base_error / error) + 1e-12 >= penalty * F.log(bpp / base_bpp)
    return F.when((bpp <= 0) | (base_bpp <= 0) | (error > base_error), False).when(base_error == 0, (error == 0) & (bpp <= base_bpp)).when(error == 0, True).otherwise(pays)


def palette_fault(width, height, block, local, shared, palettes, bits, blocks, most) -> Column:
    """The first constraint of a palette image that its numbers break, as its reader names it, or the empty string.

    ``blocks`` is the number of blocks that it has, ``most`` its greatest colour byte.
    """
    power = lambda v: (v > 0) & (v.bitwiseAND(v - 1) == 0)
    limits = {"block": (block, 2, 256), "local": (local, 2, 16), "shared": (shared, 2, 256), "palettes": (palettes, 1, 128)}
    fault = F.when(~(width.between(1, 1 << 24) & height.between(1, 1 << 24)), "bad dimensions")
    for name, (v, low, high) in limits.items():
        fault = fault.when(~power(v), f"{name} is not a power of two").when(~v.between(low, high), f"{name} out of range")
    fault = fault.when((local > shared) | (local > block * block), "more local colours than shared colours or pixels").when(~bits.isin(16, 24), "bad colour mode")
    return fault.when(blocks != F.ceil(width / block) * F.ceil(height / block), "wrong number of blocks").when(most > 255, "value out of range").otherwise("")


def grid(baseline: dict[str, int], profiles: list[tuple[int, int, int]], palettes: tuple[int, ...] = (2, 16, 32, 64), bits: tuple[int, ...] = (16, 24)) -> list[dict[str, int]]:
    """The baseline, then every profile (block, local, shared) with every number of palettes and colour depth, each once."""
    shapes = [*profiles, tuple(baseline[k] for k in SETTINGS[:3])]
    rows = [tuple(baseline[k] for k in SETTINGS)] + [(*s, p, b) for p in palettes for b in bits for s in shapes]
    return [dict(zip(SETTINGS, row, strict=True)) for row in dict.fromkeys(rows)]


def screened(sizes: DataFrame, candidates: list[dict[str, int]], baseline: dict[str, int], target: float, low: float, high: float) -> DataFrame:
    """Candidates worth encoding for each (image_id, width, height), a row each: those of ``shortlisted``."""
    rows = shortlisted(sizes.select("image_id", "width", "height"), candidates, baseline, target, low, high)
    return rows.select("image_id", F.explode("tried").alias("s")).select("image_id", "s.*")


def shortlisted(sizes: DataFrame, candidates: list[dict[str, int]], baseline: dict[str, int], target: float, low: float, high: float) -> DataFrame:
    """Adds ``tried``, the candidates worth encoding for an image of ``width`` and ``height``, found from rates alone and without a shuffle.

    These are all within ``low`` to ``high`` bits per pixel; where none is, the
    nearest to ``target``; and the same among the candidates of the baseline's
    family, those with its palettes and colour depth.
    """
    lg = lambda v: v.bit_length() - 1

    def constants(i: int, s: dict[str, int]) -> dict:
        """A candidate with what the formula of ``rate_bits`` takes from it alone, so that a row pays for none of it."""
        direct = s["local"] == s["block"] ** 2
        rate = {"fixed": s["palettes"] * s["shared"] * s["bits"], "a_block": lg(s["palettes"]) + s["local"] * lg(s["shared"]), "a_pixel": 0 if direct else lg(s["local"])}
        own = s["palettes"] == baseline["palettes"] and s["bits"] == baseline["bits"]
        return {"place": i, "family": own, **{k: s[k] for k in SETTINGS}, **rate}

    width, height = c("width").cast("long"), c("height").cast("long")
    # one literal: a plan of some thousands takes longer to make than to run
    kinds = ["place:int", "family:boolean", *[f"{k}:bigint" for k in (*SETTINGS, "fixed", "a_block", "a_pixel")]]
    each = F.from_json(F.lit(json.dumps([constants(i, s) for i, s in enumerate(candidates)])), f"array<struct<{','.join(kinds)}>>")
    blocks = lambda s: F.ceil(width / s["block"]) * F.ceil(height / s["block"])
    paid = lambda s: F.struct((s["fixed"] + blocks(s) * s["a_block"] + width * height * s["a_pixel"]).cast("long").alias("payload_bits"), s.alias("s"))
    area = c("width").cast("double") * c("height")
    weighed = lambda p: F.struct((p["payload_bits"] / area).alias("bpp"), p["payload_bits"].alias("payload_bits"), p["s"].alias("s"))

    def rated(p: Column) -> Column:
        # compared in this order where the nearest is sought
        return F.struct(
            F.abs(p["bpp"] - target).alias("distance"), p["bpp"].alias("bpp"), p["s"]["place"].alias("place"), p["payload_bits"].alias("payload_bits"), p["bpp"].between(low, high).alias("inside"),
            p["s"]["family"].alias("family"), *[p["s"][k].alias(k) for k in SETTINGS],
        )

    def wanted(rows: Column) -> Column:
        inside = F.filter(rows, lambda s: s["inside"])
        return F.when(F.size(inside) > 0, inside).when(F.size(rows) > 0, F.array(F.array_min(rows))).otherwise(rows)

    # in three steps, each of which reads what the one before worked out: a lambda works out an expression each time it is named
    rows = sizes.select("*", F.transform(F.transform(F.transform(each, paid), weighed), rated).alias("rows"))
    kept = F.array_distinct(F.concat(wanted(c("rows")), wanted(F.filter("rows", lambda s: s["family"]))))
    return rows.withColumn("tried", kept).drop("rows")


def choose(tried: DataFrame) -> DataFrame:
    """One row of ``tried`` for each image, and ``guarded``: whether it is the family's because the best did not pay.

    Of (image_id, inside, family, error, distance, bpp, payload_bits, place):
    least error within the window, then nearest rate, fewest bits and first
    place; the nearest rate where no row is within it. The best of all must pay for its rate
    against the best of the family, if there is one.
    """
    inside = c("inside")
    order = F.struct(
        (~inside).alias("out"), F.when(inside, c("error").cast("double")).otherwise(c("distance")).alias("a"), F.when(inside, c("distance")).otherwise(c("bpp")).alias("b"),
        F.when(inside, c("payload_bits")).otherwise(0).alias("c"), "place",
    )
    row = F.struct(*[k for k in tried.columns if k != "image_id"])
    best = tried.groupBy("image_id").agg(F.min_by(row, order).alias("s"), F.min_by(row, F.when(c("family"), order)).alias("f"))
    pays = rate_guard(c("s.error"), c("s.bpp"), c("f.error"), c("f.bpp"))
    judged = best.withColumn("guarded", c("f").isNotNull() & ~pays)
    return judged.select("image_id", "guarded", F.when(c("guarded"), c("f")).otherwise(c("s")).alias("s")).select("image_id", "s.*", "guarded")
