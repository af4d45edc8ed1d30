"""Rounding, clamping, bit and hash expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def round_signed(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def divide_signed(x: Column, by: int | Column) -> Column:
    """Integer quotient of an integer column, rounded to nearest, halves away from zero; ``by`` is positive."""
    by = by if isinstance(by, Column) else F.lit(by)
    up = F.floor((F.abs(x) * 2 + by) / (by * 2)).cast("long")
    return F.when(x < 0, -up).otherwise(up)


def divide_even(x: Column, by: int) -> Column:
    """divide_signed for an even divisor, in whole numbers alone; exact for any long that leaves room for the divisor."""
    half = by // 2
    up = F.call_function("div", F.abs(x) + F.lit(half), F.lit(by).cast("long"))
    return F.when(x < 0, -up).otherwise(up)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bits_required(x: Column) -> Column:
    """Bits of a non-negative integer, 0 for 0."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x)))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def log2_exact(x: Column) -> Column:
    """Exponent of a power of two."""
    return F.length(F.bin(x)) - 1


def unsigned_golomb_bits(v: Column) -> Column:
    """Length of the Exp-Golomb code of a non-negative integer."""
    return 2 * (F.length(F.bin(v + 1)) - 1) + 1


def zigzag_sign(v: Column) -> Column:
    """Signed to unsigned for Exp-Golomb: 0, 1, -1, 2, -2 become 0, 1, 2, 3, 4."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def signed_golomb_bits(v: Column) -> Column:
    return unsigned_golomb_bits(zigzag_sign(v))


def fnv1a(values: Column) -> Column:
    """32-bit FNV-1a over an array of bytes, as a long."""
    start = F.lit(2166136261).cast("long")
    return F.aggregate(values, start, lambda h, v: F.pmod(h.bitwiseXOR(v.cast("long")) * 16777619, F.lit(1 << 32)))


def mix(a: Column, b: Column, amount: Column) -> Column:
    return a + (b - a) * amount


def psnr(mse: Column, infinite: Column | None = None) -> Column:
    """Decibels for a peak of 255; at zero error the given value, by default infinity."""
    return F.when(mse == 0, infinite if infinite is not None else F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / mse))
