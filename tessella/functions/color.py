"""Colour expressions over byte columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.numeric import clamp, divide_even, half_up

# The sRGB transfer curve, the OKLab matrices and the luma weights.
SRGB_BREAK, LINEAR_BREAK = 0.04045, 0.0031308
TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
TO_LAB = (
    (0.2104542553, 0.793617785, -0.0040720468),
    (1.9779984951, -2.428592205, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.808675766),
)
FROM_LAB = (
    (1.0, 0.3963377774, 0.2158037573),
    (1.0, -0.1055613458, -0.0638541728),
    (1.0, -0.0894841775, -1.291485548),
)
FROM_LMS = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.707614701),
)
LUMA_709 = (0.2126, 0.7152, 0.0722)
#: Sixteen-bit fixed-point rows of the JFIF transform: Y, Cb, Cr.
YCC_FIXED = ((19595, 38470, 7471), (-11059, -21709, 32768), (32768, -27439, -5329))


def _dot(row: tuple, xs: tuple[Column, ...]) -> Column:
    return sum((F.lit(k) * x for k, x in zip(row[1:], xs[1:], strict=True)), F.lit(row[0]) * xs[0])


def srgb_to_linear(v: Column) -> Column:
    x = clamp(v, 0, 255) / F.lit(255.0)
    return F.when(x <= SRGB_BREAK, x / F.lit(12.92)).otherwise(F.pow((x + 0.055) / F.lit(1.055), F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """Linear light to the byte scale, not rounded."""
    x = clamp(v, 0.0, 1.0)
    return F.when(x <= LINEAR_BREAK, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055) * 255


def rgb_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    linear = tuple(srgb_to_linear(v) for v in (r, g, b))
    lms = tuple(F.cbrt(_dot(row, linear)) for row in TO_LMS)
    return tuple(_dot(row, lms) for row in TO_LAB)


def oklab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    lms = tuple(_dot(row, (lightness, a, b)) for row in FROM_LAB)
    return tuple(linear_to_srgb(_dot(row, tuple(v * v * v for v in lms))) for row in FROM_LMS)


def rgb_to_ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """JFIF luma and chroma as doubles, chroma about 128."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b


def rgb_to_ycc_fixed(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The same in 16-bit fixed point, as bytes."""
    out = []
    for row, base in zip(YCC_FIXED, (0, 128, 128), strict=True):
        total = sum((F.lit(k).cast("long") * v for k, v in zip(row[1:], (g, b), strict=True)), F.lit(row[0]).cast("long") * r)
        out.append(clamp(divide_even(total, 65536) + base, 0, 255))
    return tuple(out)


def ycc_to_rgb_fixed(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    u, v = cb - 128, cr - 128
    return (
        clamp(y + divide_even(91881 * v, 65536), 0, 255),
        clamp(y + divide_even(-22554 * u - 46802 * v, 65536), 0, 255),
        clamp(y + divide_even(116130 * u, 65536), 0, 255),
    )


def luma(r: Column, g: Column, b: Column) -> Column:
    return _dot(LUMA_709, (r, g, b))


def quantise_channel(v: Column, bits: int) -> Column:
    top = (1 << bits) - 1
    return half_up(v * top / F.lit(255.0)).cast("long")


def expand_rounded(q: Column, bits: int) -> Column:
    """Code to byte by rounding, as palettes store it."""
    return half_up(q * 255 / F.lit(float((1 << bits) - 1))).cast("long")


def expand_replicated(q: Column, bits: int) -> Column:
    """Code to byte by repeating its high bits, as block textures store it."""
    return F.shiftleft(q, 8 - bits).bitwiseOR(F.shiftright(q, 2 * bits - 8))


def pack565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(quantise_channel(r, 5), 11).bitwiseOR(F.shiftleft(quantise_channel(g, 6), 5)).bitwiseOR(quantise_channel(b, 5))


def color_key(r: Column, g: Column, b: Column) -> Column:
    """Red, green and blue as one 24-bit number."""
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def color_hex(key: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(key)), 6, "0"))
