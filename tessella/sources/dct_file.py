"""Transform images: independent 16 by 16 units of a fixed number of bytes.

Any pixel is read from its own unit, found by multiplication. A unit has luma
(one block of 16 by 16 or four of 8 by 8) and two chroma blocks; each block is a
fixed-size record. An optional library of prototypes for the whole image follows
the units.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

import numpy as np

from tessella.functions.coding import scan
from tessella.operators.transform import forward_float, inverse_float
from tessella.sources.bits import low_field_at
from tessella.sources.dct_records import CODINGS, Coding, choose, read, steps, write, written, written_with_library

# Magic, version, flags, presets (mode, bytes of a unit and of Y, Cb, Cr) and library versions.
MAGIC, VERSION, HEAD = b"DCTBS2\0\0", 2, 64
AUTO, SPLIT, LIBRARY, HALF, ZIGZAG = 1, 2, 4, 8, 16
PRESETS = {
    "0.75": (750, 24, 8, 8, 8),
    "1": (1000, 32, 16, 8, 8),
    "1.5": (1500, 48, 24, 12, 12),
    "2": (2000, 64, 32, 16, 16),
    "3": (3000, 96, 64, 16, 16),
    "4.5": (4500, 144, 96, 24, 24),
    "6": (6000, 192, 128, 32, 32),
    "7.5": (7500, 240, 160, 40, 40),
    "9": (9000, 288, 192, 48, 48),
}
DEFAULT_CODING = {"0.75": 3, "1": 4, "1.5": 4, "2": 4, "3": 5, "4.5": 5, "6": 2, "7.5": 2, "9": 2}
CHROMA_BUDGETS = {"3": (8, 12, 20), "2": (8,), "1.5": (8,), "1": (), "0.75": ()}
WIDE_BUDGETS = {"3": (8, 10, 12, 14, 16, 18, 20, 22, 24), "2": (8, 9, 10), "1.5": (8, 9), "1": (8,), "0.75": (8,)}
LIBRARY_MAGIC, LIBRARY_HEAD = b"DCTLIB1\0", struct.Struct("<8s6I")
LIBRARY_KINDS = {1: ("tail", 0.0), 2: ("header", 0.0), 3: ("header", 0.25), 4: ("header", 0.5), 5: ("header", 1.0), 6: ("sidecar", 0.0), 7: ("sidecar", 0.25), 8: ("sidecar", 0.5), 9: ("sidecar", 1.0)}
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


@dataclass(frozen=True)
class Layout:
    width: int
    height: int
    mode: int
    unit: int
    sizes: tuple[int, int, int]
    split: bool
    half: bool = True  # chroma at half height as well as width

    @property
    def across(self) -> int:
        return -(-self.width // 16)

    @property
    def units(self) -> int:
        return self.across * -(-self.height // 16)

    def records(self) -> list[tuple[int, int, int, int, int]]:
        """(component, width, height, offset in the unit, bytes) of each record of a unit."""
        y, cb, cr = self.sizes
        luma = [(0, 8, 8, k * y // 4, y // 4) for k in range(4)] if self.split else [(0, 16, 16, 0, y)]
        tall = 8 if self.half else 16
        return [*luma, (1, 8, tall, y, cb), (2, 8, tall, y + cb, cr)]

    def check(self) -> None:
        y, cb, cr = self.sizes
        if y + cb + cr != self.unit or min(cb, cr) < 8 or (self.split and y % 4) or y // (4 if self.split else 1) < 3:
            raise ValueError("bad allocation of bytes")


def layout_for(width: int, height: int, preset: str, split: bool | None = None, sizes: tuple[int, int, int] | None = None, half: bool = True) -> Layout:
    mode, unit, *default = PRESETS[preset]
    out = Layout(width, height, mode, unit, sizes or tuple(default), unit >= 96 if split is None else split, half)
    out.check()
    return out


def planes(rgb: np.ndarray, layout: Layout) -> list[np.ndarray]:
    """For each record of a unit, (units, h, w) samples about zero."""
    h, w = rgb.shape[:2]
    across, down = layout.across, layout.units // layout.across
    full = rgb[np.minimum(np.arange(down * 16), h - 1)][:, np.minimum(np.arange(across * 16), w - 1)].astype(np.float64)
    ycc = (full @ YCC.T).reshape(down, 16, across, 16, 3).swapaxes(1, 2).reshape(-1, 16, 16, 3)
    luma = ycc[..., 0] - 128
    rows = 2 if layout.half else 1
    chroma = [ycc[..., c].reshape(-1, 16 // rows, rows, 8, 2).mean(axis=(2, 4)) for c in (1, 2)]
    if layout.split:
        return [luma[:, y : y + 8, x : x + 8] for y in (0, 8) for x in (0, 8)] + chroma
    return [luma, *chroma]


def _upsampled(plane: np.ndarray, half: bool) -> np.ndarray:
    if not half:
        return np.repeat(plane, 2, axis=2)
    at = np.arange(16)
    low, w = at // 2 - (at % 2 == 0), np.where(at % 2 == 0, 3, 1)
    a, b = np.clip(low, 0, 7), np.clip(low + 1, 0, 7)
    rows = plane[:, :, a] * (4 - w) + plane[:, :, b] * w
    return (rows[:, a] * (4 - w)[:, None] + rows[:, b] * w[:, None]) / 16


def unit_pixels(coefficients: list[np.ndarray], layout: Layout) -> np.ndarray:
    """(n, 16, 16, 3) bytes from the coefficients of each record (n, h, w)."""
    back = [inverse_float(f) for f in coefficients]
    if layout.split:
        luma = np.block([[back[0], back[1]], [back[2], back[3]]])
    else:
        luma = back[0]
    u, v = (_upsampled(p, layout.half) for p in back[-2:])
    y = luma + 128
    rgb = np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


def _image(units: np.ndarray, layout: Layout) -> np.ndarray:
    down = layout.units // layout.across
    return units.reshape(down, layout.across, 16, 16, 3).swapaxes(1, 2).reshape(down * 16, -1, 3)[: layout.height, : layout.width]


def cluster(vectors: np.ndarray, k: int, w: int, h: int, quality: int, chroma: bool, rounds: int = 6, features: int = 32) -> np.ndarray:
    """Prototypes of coefficient vectors: the mean and vectors far from it, then six steps of k-means over the low frequencies."""
    k = min(k, len(vectors))
    if k < 1:
        return np.zeros((0, w * h))
    at = np.array([0, *scan(0, w, h)[: features - 1]])
    scaled = vectors[:, at] / steps(w, h, quality, chroma)[at]
    centers = [vectors.mean(axis=0)]
    gauge = lambda c: ((scaled - c[at] / steps(w, h, quality, chroma)[at]) ** 2).sum(axis=1)
    near = gauge(centers[0])
    while len(centers) < k:
        centers.append(vectors[int(near.argmax())].copy())
        near = np.minimum(near, gauge(centers[-1]))
    for _ in range(rounds):
        own = np.stack([gauge(c) for c in centers], axis=1).argmin(axis=1)
        for j in range(k):
            if (own == j).any():
                centers[j] = vectors[own == j].mean(axis=0)
    return np.array(centers)


def _library(f: list[np.ndarray], layout: Layout, quality: int, coding: Coding, size: int) -> list[tuple[list[bytes], list[np.ndarray]]]:
    """Stored records and their coefficients for Y, Cb and Cr."""
    out = []
    for component in range(3):
        mine = [(r, v) for r, v in zip(layout.records(), f, strict=True) if r[0] == component]
        _, w, h, _, n = mine[0][0]
        vectors = np.stack([v for _, v in mine], axis=1).reshape(-1, w * h)
        stored = [write(choose(c, w, h, n, quality, component > 0, coding, False), n) for c in cluster(vectors, size, w, h, quality, component > 0)]
        out.append((stored, [read(s, w, h, quality, component > 0, coding) for s in stored]))
    return out


def encode(rgb: np.ndarray, preset: str = "2", quality: int = 75, coding: int | None = None, zigzag_order: bool = True, split: bool | None = None, sizes: tuple[int, int, int] | None = None, half: bool = True, library: int = 0, library_kind: int = 7, auto: bool = False, candidates: int = 0) -> bytes:
    """An image (height, width, 3); ``library`` is the number of prototypes, ``library_kind`` the stored version."""
    if not 1 <= quality <= 100:
        raise ValueError("quality out of range")
    layout = layout_for(rgb.shape[1], rgb.shape[0], preset, split, sizes, half)
    if library:
        coding, zigzag_order = 2 if (coding if coding is not None else DEFAULT_CODING[preset]) >= 5 else 1, False
    kind = replace(CODINGS[DEFAULT_CODING[preset] if coding is None else coding], zigzag=zigzag_order)
    f = [forward_float(p) for p in planes(rgb, layout)]
    records = layout.records()
    flat = [v.reshape(len(v), -1) for v in f]
    units, trailer, flags = np.zeros((layout.units, layout.unit), dtype=np.uint8), b"", 0
    books = _library(flat, layout, quality, kind, library) if library else None
    reference, share = LIBRARY_KINDS[library_kind]
    if library > {"header": 3, "tail": 31, "sidecar": 63}[reference]:
        raise ValueError("too many prototypes")
    chosen: list[list[np.ndarray]] = [[], [], []]
    for (component, w, h, at, n), v in zip(records, flat, strict=True):
        if books:
            units[:, at : at + n], k = written_with_library(v, books[component][1], w, h, n, quality, component > 0, kind, reference, share)
            chosen[component].append(k)
        else:
            units[:, at : at + n] = written(v, w, h, n, quality, component > 0, kind)
    used = [np.stack(ks, axis=1).ravel().tolist() if ks else [] for ks in chosen]  # unit by unit
    if books:
        side = b""
        if reference == "sidecar":
            for ks, (stored, _) in zip(used, books, strict=True):
                bits = len(stored).bit_length()
                side += sum(k << i * bits for i, k in enumerate(ks)).to_bytes(-(-len(ks) * bits // 8), "little")
        body = side + b"".join(b"".join(stored) for stored, _ in books)
        trailer = LIBRARY_HEAD.pack(LIBRARY_MAGIC, library_kind, *(len(s) for s, _ in books), records[0][4], LIBRARY_HEAD.size + len(body)) + body
    flags = (AUTO if auto else 0) | (SPLIT if layout.split else 0) | (LIBRARY if books else 0) | (HALF if half else 0) | (ZIGZAG if zigzag_order else 0) | kind.number << 8
    head = MAGIC + struct.pack("<14I", VERSION, layout.mode, layout.width, layout.height, layout.across, layout.units // layout.across, layout.unit, *layout.sizes, quality, flags, layout.units * layout.unit, len(trailer) if books else candidates)
    return head + units.tobytes() + trailer


class Transformed:
    """An opened file."""

    def __init__(self, data: bytes):
        if len(data) < HEAD or data[:8] != MAGIC:
            raise ValueError("not a transform image")
        version, mode, width, height, across, down, unit, y, cb, cr, self.quality, flags, payload, last = struct.unpack_from("<14I", data, 8)
        modes = {p[0]: p for p in PRESETS.values()}
        if version != VERSION or mode not in modes or modes[mode][1] != unit or flags & ~(AUTO | SPLIT | LIBRARY | HALF | ZIGZAG | 15 << 8) or not 1 <= self.quality <= 100 or flags >> 8 >= len(CODINGS):
            raise ValueError("unsupported header")
        self.layout = Layout(width, height, mode, unit, (y, cb, cr), bool(flags & SPLIT), bool(flags & HALF))
        self.layout.check()
        if not (width and height) or (across, down) != (self.layout.across, self.layout.units // self.layout.across) or payload != self.layout.units * unit or len(data) != HEAD + payload + (last if flags & LIBRARY else 0):
            raise ValueError("the size of the file does not match its header")
        self.data, self.coding = data, replace(CODINGS[flags >> 8], zigzag=bool(flags & ZIGZAG))
        self.books, self.reference, self.share, self.side = [[], [], []], None, 0.0, [None] * 3
        self._last = (-1, None)
        if flags & LIBRARY:
            self._open_library(HEAD + payload, last)

    def _open_library(self, at: int, size: int) -> None:
        magic, version, *counts, record, total = LIBRARY_HEAD.unpack_from(self.data, at)
        records = self.layout.records()
        if magic != LIBRARY_MAGIC or version not in LIBRARY_KINDS or total != size or record != records[0][4]:
            raise ValueError("bad library")
        self.reference, self.share = LIBRARY_KINDS[version]
        at += LIBRARY_HEAD.size
        if self.reference == "sidecar":
            for c in range(3):
                bits, n = counts[c].bit_length(), self.layout.units * sum(r[0] == c for r in records)
                self.side[c] = (at, bits)
                at += -(-n * bits // 8)
        for c in range(3):
            _, w, h, _, n = next(r for r in records if r[0] == c)
            for _ in range(counts[c]):
                self.books[c].append(read(self.data[at : at + n], w, h, self.quality, c > 0, self.coding))
                at += n

    def record(self, unit: int, number: int) -> np.ndarray:
        """Coefficients (h, w) of one record of one unit."""
        records = self.layout.records()
        c, w, h, at, n = records[number]
        start, index = HEAD + unit * self.layout.unit + at, 0
        if self.side[c]:
            mine = [k for k, r in enumerate(records) if r[0] == c]
            where, bits = self.side[c]
            index = low_field_at(self.data[where:], (unit * len(mine) + mine.index(number)) * bits, bits) if bits else 0
        f = read(self.data[start : start + n], w, h, self.quality, c > 0, self.coding, self.books[c], self.reference, self.share, index)
        return f.reshape(h, w)

    def unit(self, number: int) -> np.ndarray:
        """(16, 16, 3) bytes of one unit."""
        return unit_pixels([self.record(number, k)[None] for k in range(len(self.layout.records()))], self.layout)[0]

    def sample(self, x: int, y: int) -> tuple[int, int, int]:
        """One pixel, from its unit alone; the unit that was sampled last is kept."""
        if not (0 <= x < self.layout.width and 0 <= y < self.layout.height):
            raise ValueError("pixel out of range")
        number = y // 16 * self.layout.across + x // 16
        if self._last[0] != number:
            self._last = (number, self.unit(number))
        return tuple(self._last[1][y % 16, x % 16].tolist())

    def pixels(self) -> np.ndarray:
        n = len(self.layout.records())
        f = [np.stack([self.record(u, k) for u in range(self.layout.units)]) for k in range(n)]
        return _image(unit_pixels(f, self.layout), self.layout)

    def describe(self, number: int) -> list[tuple[str, int, int]]:
        """(field, first bit, bits) of a plain record, as laid out in each unit."""
        from tessella.sources.dct_records import ac_count, masked_shape

        _, w, h, _, n = self.layout.records()[number]
        shape = masked_shape(self.coding, w, h, n)
        if shape:
            mask = 60 if self.coding.implicit else 62
            parts = [("mask", mask), ("scale", 2), ("dc", shape[0])] + [("ac", shape[1])] * shape[2]
        else:
            parts = [("profile", 4), ("scale", 4), ("dc", 10)] + [("group scale", 3)] * self.coding.groups + [("ac", self.coding.bits)] * ac_count(self.coding, n, w * h - 1, int(self.reference == "tail"))
            if self.reference == "tail":
                parts.append(("prototype", self.coding.bits))
        out, at = [], 0
        for name, bits in parts:
            out.append((name, at, bits))
            at += bits
        return out + ([("padding", at, n * 8 - at)] if at < n * 8 else [])


def squared_error(rgb: np.ndarray, data: bytes) -> int:
    return int(((rgb.astype(np.int64) - Transformed(data).pixels()) ** 2).sum())


def encode_best(rgb: np.ndarray, preset: str = "2", quality: int = 75, wide: bool = False, **options) -> bytes:
    """The file of least error over allocations of bytes to components and, at high rates, over codings; the first on ties."""
    _, unit, *default = PRESETS[preset]
    split = unit >= 96
    tries = [{"sizes": tuple(default)}]
    for n in (WIDE_BUDGETS if wide else CHROMA_BUDGETS).get(preset, ()):
        if (unit - 2 * n) % (4 if split else 1) == 0 and (unit - 2 * n, n, n) != tuple(default):
            tries.append({"sizes": (unit - 2 * n, n, n)})
    if preset in ("6", "7.5", "9"):
        codings = [(2, False), (6, True), (6, False)] + ([(7, True), (7, False)] if preset == "9" else [])
        tries = [t | {"coding": k, "zigzag_order": z} for t in tries for k, z in codings]
    files = [encode(rgb, preset, quality, **(options | t)) for t in tries]
    return min(files, key=lambda d: squared_error(rgb, d))


def best_quality(rgb: np.ndarray, preset: str = "2", sample: int = 24, finalists: int = 1, **options) -> bytes:
    """The file at the quality of least error: every fifth of 20 to 95 on a sample of units, then the four on
    either side of the best, then full encodings of the leading ones."""
    layout = layout_for(rgb.shape[1], rgb.shape[0], preset)
    chosen = sorted({(2 * k + 1) * layout.units // (2 * min(sample, layout.units)) for k in range(min(sample, layout.units))})
    tiles = [rgb[u // layout.across * 16 : u // layout.across * 16 + 16, u % layout.across * 16 : u % layout.across * 16 + 16] for u in chosen]
    seen: dict[int, int] = {}

    def error(quality: int) -> int:
        if quality not in seen:
            seen[quality] = sum(squared_error(t, encode(t, preset, quality, **options)) for t in tiles)
        return seen[quality]

    middle = min(range(20, 96, 5), key=lambda q: (error(q), q))
    for q in range(max(1, middle - 4), min(100, middle + 4) + 1):
        error(q)
    leading = sorted(seen, key=lambda q: (seen[q], q))[:finalists]
    return min((encode(rgb, preset, q, auto=True, candidates=len(seen) + len(leading), **options) for q in leading), key=lambda d: squared_error(rgb, d))
