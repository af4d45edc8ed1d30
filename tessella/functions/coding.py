"""Fixed tables and orders of the block transforms."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The base quantisation tables of JPEG, row by row.
LUMA_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_TABLE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
#: Scale of the integer cosine basis.
BASIS_BITS = 14


def integer_basis() -> np.ndarray:
    """basis[x, u]: round(C(u) * cos((2x + 1) * u * pi / 16) * 2**14), C(0) = sqrt(1/2)."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.where(u == 0, np.sqrt(0.5), 1.0)
    return np.rint(c * np.cos((2 * x + 1) * u * np.pi / 16) * (1 << BASIS_BITS)).astype(np.int64)


@lru_cache(maxsize=None)
def float_basis(size: int) -> np.ndarray:
    """basis[u, x] of the orthonormal transform, read only."""
    u, x = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    basis = np.where(u == 0, np.sqrt(1 / size), np.sqrt(2 / size)) * np.cos(np.pi * (2 * x + 1) * u / (2 * size))
    basis.flags.writeable = False
    return basis


def scaled_table(base: tuple[int, ...], quality: int) -> list[int]:
    """A quantisation table for a quality of 1 to 100."""
    if quality < 50:
        raw = [(v * 5000 + 50 * quality) // (100 * quality) for v in base]
    else:
        raw = [(v * (200 - 2 * quality) + 50) // 100 for v in base]
    return [min(255, max(1, v)) for v in raw]


def quantisation_step(u: int, v: int, width: int, height: int, quality: float, chroma: bool) -> float:
    """Step of frequency (u, v) of a block of any size, at least 1."""
    table = CHROMA_TABLE if chroma else LUMA_TABLE
    tx, ty = (min(7, int(k * 7 / max(1, n - 1) + 0.5)) for k, n in ((u, width), (v, height)))
    scale = 50 / quality if quality < 50 else 2 - quality * 0.02
    return max(1.0, table[ty * 8 + tx] * scale * (width * height / 64) ** 0.5)


def zigzag(width: int, height: int) -> list[int]:
    """Positions v * width + u along the anti-diagonals, even ones by rising u, without the first."""
    cells = [(u + v, u if (u + v) % 2 == 0 else -u, v * width + u) for v in range(height) for u in range(width)]
    return [p for _, _, p in sorted(cells)[1:]]


def _by_score(width: int, height: int, score) -> list[int]:
    cells = [(score(u, v), u + v, v, u) for v in range(height) for u in range(width) if u or v]
    return [v * width + u for _, _, v, u in sorted(cells)]


def scan(profile: int, width: int, height: int) -> list[int]:
    """One of four base orders of the frequencies: diagonal, horizontal, vertical, square."""
    # The coefficients of the scores.
    scores = (
        lambda u, v: u + v + (v if (u + v) % 2 == 0 else u) * 0.001,
        lambda u, v: u + v * 2.4,
        lambda u, v: u * 2.4 + v,
        lambda u, v: max(u, v) * 1.45 + abs(u - v) * 0.1,
    )
    return _by_score(width, height, scores[profile])


def skip_scan(profile: int, width: int, height: int) -> list[int]:
    """One of eight orders over frequencies scaled to 0..1."""
    # The coefficients of the scores.
    scores = (
        lambda u, v, r: r * r,
        lambda u, v, r: 0.22 * u * u + 2.1 * v * v,
        lambda u, v, r: 2.1 * u * u + 0.22 * v * v,
        lambda u, v, r: min(0.18 * u * u + 2.4 * v * v, 2.4 * u * u + 0.18 * v * v),
        lambda u, v, r: 0.72 * r * r + 1.35 * abs(u - v),
        lambda u, v, r: 0.72 * r * r + 0.55 * min(u, v) + 0.08 * abs(u - v),
        lambda u, v, r: abs(r - 0.34) + 0.18 * r,
        lambda u, v, r: abs(r - 0.52) + 0.10 * min(u, v),
    )

    def score(u: int, v: int) -> float:
        a, b = (u / (width - 1) if width > 1 else 0.0), (v / (height - 1) if height > 1 else 0.0)
        return scores[profile](a, b, (a * a + b * b) ** 0.5)

    return _by_score(width, height, score)
