"""Fixed-size records of transform coefficients.

A record holds one component of a unit: a profile, a scale, the first
coefficient and as many others as fit. How these are chosen and packed depends
on the coding; all choices lower the squared error of the coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tessella.functions.coding import quantisation_step, scan, skip_scan, zigzag
from tessella.sources.bits import low_field_at

# Multipliers of the steps, the codings by number, and the shapes of masked records.
SCALES = np.array([1, 2, 4, 8, 16, 32, 64, 128])


@dataclass(frozen=True)
class Coding:
    number: int
    bits: int
    groups: int
    front: bool = False
    skip: str | None = None
    masked: bool = False
    implicit: bool = False
    zigzag: bool = False


CODINGS = (
    Coding(0, 6, 0),
    Coding(1, 5, 2),
    Coding(2, 5, 3, True),
    Coding(3, 5, 2, False, "single"),
    Coding(4, 5, 2, False, "dual"),
    Coding(5, 5, 3, True, "dual"),
    Coding(6, 5, 3, True, None, True),
    Coding(7, 5, 3, True, None, True, True),
)
#: bytes: (bits of the first coefficient, bits of the others, how many others)
MASKED = {16: (10, 6, 9), 24: (9, 7, 17), 32: (8, 8, 23), 40: (8, 8, 31), 48: (10, 8, 38)}
IMPLICIT = {48: (10, 8, 39)}
IMPLICIT_PLACES = (1, 8)


@lru_cache(maxsize=None)
def steps(w: int, h: int, quality: int, chroma: bool) -> np.ndarray:
    return np.array([quantisation_step(u, v, w, h, quality, chroma) for v in range(h) for u in range(w)])


@lru_cache(maxsize=None)
def profile_scan(coding: Coding, profile: int, w: int, h: int, skip: bool = False) -> np.ndarray:
    if coding.zigzag:
        if profile == 0:
            return np.array(zigzag(w, h))
        profile -= 1
    return np.array((skip_scan if skip else scan)(profile, w, h))


def profiles(coding: Coding, skip: bool = False) -> int:
    return (8 if skip else 4) + coding.zigzag


def split_scan(full: np.ndarray, count: int, split: float) -> np.ndarray:
    """The first places of a scan; a share of them is moved beyond ``count`` where a prototype covers the low ones."""
    high = min(max(0, len(full) - count), int(count * split + 0.5)) if split > 0 else 0
    return np.concatenate([full[: count - high], full[count : count + high]])


def masked_shape(coding: Coding, w: int, h: int, size: int) -> tuple[int, int, int] | None:
    if not coding.masked or (w, h) != (8, 8):
        return None
    return (IMPLICIT if coding.implicit else MASKED).get(size)


def _round(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def _stored(f: np.ndarray, step: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``bits`` bits and by how much they lower the squared error."""
    q = np.clip(_round(f / step), -(1 << bits - 1), (1 << bits - 1) - 1)
    return q.astype(np.int64), f**2 - (f - q * step) ** 2


def group_ends(coding: Coding, count: int) -> list[int]:
    if coding.front:
        return [-(-count // 6), -(-count // 2), count]
    return [(k + 1) * count // coding.groups for k in range(coding.groups)]


def ac_count(coding: Coding, size: int, places: int, reserved: int = 0) -> int:
    n = (size * 8 - 18 - 3 * coding.groups) // coding.bits - reserved
    return max(0, min(places, n) if coding.groups else n)


@dataclass
class Record:
    """A chosen form: fields in the order in which they are written, as (value, bits)."""

    fields: list[tuple[int, int]]
    gain: float
    low_first: bool = False
    order: tuple = ()


@dataclass
class Records:
    """Chosen forms of many vectors, which all have the same fields: values (n, fields), the bits of each field and gains."""

    values: np.ndarray
    bits: list[int]
    gain: np.ndarray

    def one(self) -> Record:
        return Record(list(zip(map(int, self.values[0]), self.bits, strict=True)), float(self.gain[0]))

    def packed(self, size: int) -> np.ndarray:
        """(n, size) bytes, each row as ``write`` gives it."""
        field = np.repeat(np.arange(len(self.bits)), self.bits)
        shift = np.concatenate([np.arange(b)[::-1] for b in self.bits])
        out = np.zeros((len(self.values), size * 8), dtype=np.uint8)
        out[:, : len(field)] = self.values[:, field] >> shift & 1
        return np.packbits(out, axis=1)


def _better(best: Records | None, values: np.ndarray, bits: list[int], gain: np.ndarray) -> Records:
    """Of two forms of each vector the one that gains more, the first if both gain the same."""
    if best is None:
        return Records(values, bits, gain)
    up = gain > best.gain
    return Records(np.where(up[:, None], values, best.values), bits, np.where(up, gain, best.gain))


def _scaled(f: np.ndarray, step: np.ndarray, bits: int, scales: np.ndarray = SCALES) -> tuple[np.ndarray, np.ndarray]:
    """Values and gains (scales, n, places) of vectors (n, places)."""
    return _stored(f[None], step * scales[:, None, None], bits)


def _plain(f: np.ndarray, step: np.ndarray, w: int, h: int, size: int, coding: Coding, reserved: int = 0, split: float = 0.0, most: int = 99, high_bits: int = 0) -> Records:
    """The best profile and scales of records (n, places) without skips; ``high_bits`` go above the profile."""
    count, rows = ac_count(coding, size, w * h - 1, reserved), np.arange(len(f))
    first_q, first_g = (x[..., 0] for x in _scaled(f[:, :1], step[:1], 10))
    q, g = _scaled(f, step, coding.bits)
    best = None
    for profile in range(min(profiles(coding), most)):
        at = split_scan(profile_scan(coding, profile, w, h), count, split)
        head = profile | high_bits
        if coding.groups:
            scale = first_g.argmax(axis=0)
            gain, values, scales, start = first_g[scale, rows], [], [], 0
            for end in group_ends(coding, count):
                mine = at[start:end]
                gains = g.take(mine, axis=2).sum(axis=2)
                pick = gains.argmax(axis=0)
                scales.append(pick)
                values.append(q[pick, rows].take(mine, axis=1))
                gain, start = gain + gains[pick, rows], end
            fields = np.column_stack([head << 4 | scale, first_q[scale, rows], *scales, *values])
            best = _better(best, fields, [8, 10] + [3] * coding.groups + [coding.bits] * count, gain)
        else:
            gains = g.take(at, axis=2).sum(axis=2)
            for k in range(len(SCALES)):
                fields = np.column_stack([np.full(len(f), head << 4 | k), first_q[k], q[k].take(at, axis=1)])
                best = _better(best, fields, [8, 10] + [coding.bits] * len(at), first_g[k] + gains[k])
    return best


@lru_cache(maxsize=None)
def skip_layout(size: int, w: int, h: int, mode: str) -> tuple[int, int, int]:
    """Tokens, how many of them are coarse, and extra fine values at the end."""
    bits, whole = size * 8 - 18, (w, h) == (16, 16)
    if mode == "single":
        tokens = coarse = bits // 8
    elif size in (16, 24, 32):
        tokens, coarse = {32: (32, 16), 24: (24, 12 if whole else 11), 16: (15, 7) if whole else (14, 8)}[size]
    else:
        tokens = bits // 7
        while -(-tokens // 2) * 8 + (tokens // 2) * 6 > bits:
            tokens -= 1
        coarse = -(-tokens // 2)
    spare = bits - coarse * 8 - (tokens - coarse) * 6
    if tokens < 1 or spare < 0:
        raise ValueError("the record is too small for this coding")
    return tokens, coarse, 0 if spare < 4 else 1 + (spare - 4) // 6


def _ahead(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (..., n + 4) the greatest of the four places after each of n places, and how many places are passed over to it."""
    n = gain.shape[-1] - 4
    best, skip = gain[..., 1 : n + 1].copy(), np.zeros((*gain.shape[:-1], n), dtype=np.int8)
    for d in range(2, 5):
        np.copyto(skip, d - 1, where=gain[..., d : n + d] > best)
        np.maximum(best, gain[..., d : n + d], out=best)
    return best, skip


def _at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value at each place: (..., n) and (...)."""
    return np.take_along_axis(values, place[..., None], axis=-1)[..., 0]


def _skips(f: np.ndarray, step: np.ndarray, w: int, h: int, size: int, coding: Coding) -> Records:
    """Tokens along a scan, each a value and how many places to pass over; chosen by dynamic programming.

    All vectors (n, places) and all eight scales are worked on at once. The tail is chosen the same way.
    A token moves on by one to four places, so token t is at one of the places t to 4 * t and no others are looked at.
    """
    tokens, coarse, tail = skip_layout(size, w, h, coding.skip)
    usable = lambda q, g: (np.where(g > 0, q, 0), np.maximum(g, 0))
    finer = [1 if k >= 3 else 0 for k in range(len(SCALES))]
    wide, narrow = usable(*_scaled(f, step, 6)), usable(*_scaled(f, step, 4, SCALES[:2]))
    first_q, first_g = (x[..., 0] for x in _scaled(f[:, :1], step[:1], 10))
    rows, best = np.arange(len(f)), None
    bits = [8, 10] + [b for t in range(tokens) for b in (6 if t < coarse else 4, 2)] + [4, 2] * (tail - 1) + [4] * (tail > 0)
    for profile in range(profiles(coding, True)):
        at = profile_scan(coding, profile, w, h, True)[: 4 * (tokens - 1 + tail) + 1]
        n = len(at)
        gains = [wide[1].take(at, axis=2), narrow[1].take(at, axis=2)[finer]]
        # ahead[t]: what tokens from t on can still gain if token t is at a place
        ahead, step_to = np.full((*gains[0].shape[:2], n + 4), -np.inf), []
        ahead[..., :n] = gains[1 if tokens > coarse else 0]
        for t in range(tokens - 2, -1, -1):
            a, b = min(t, n - 1), min(4 * t + 1, n)
            most, skip = _ahead(ahead[..., a : b + 4])
            step_to.append((a, skip))
            ahead[..., a:b] = gains[0 if t < coarse else 1][..., a:b] + most
        step_to.reverse()
        path = [np.zeros(gains[0].shape[:2], dtype=np.int64)]
        for a, skip in step_to:
            path.append(path[-1] + 1 + _at(skip, path[-1] - a))
        extra, more, link = _tail(gains[1], path[-1], tail)
        gain = first_g + ahead[..., 0] + more
        k = gain.argmax(axis=0)
        path, extra, link = [x[k, rows] for x in path], [x[k, rows] for x in extra], link[k, rows]
        coarse_q, fine_q = wide[0][k, rows], narrow[0][np.array(finer)[k], rows]
        fields = [profile << 4 | 8 | k, first_q[k, rows]]
        for t, place in enumerate(path):
            fields += [(coarse_q if t < coarse else fine_q)[rows, at[place]], path[t + 1] - place - 1 if t + 1 < tokens else link]
        for t, place in enumerate(extra):
            fields.append(np.where(place >= 0, fine_q[rows, at[place]], 0))
            if t + 1 < len(extra):
                fields.append(np.where((place >= 0) & (extra[t + 1] >= 0), extra[t + 1] - place - 1, 0))
        best = _better(best, np.column_stack(fields), bits, gain[k, rows])
    return best


def _tail(gain: np.ndarray, last: np.ndarray, count: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places of the extra values after place ``last`` (-1 past the end), their gain, and the skip to the first."""
    if not count:
        return [], np.zeros(last.shape), np.zeros(last.shape, dtype=np.int64)
    n = gain.shape[-1]
    padded, value, steps_to = np.full((*last.shape, n + 4), -np.inf), np.zeros(gain.shape), []
    for _ in range(count):
        padded[..., :n] = gain + value
        most, skip = _ahead(padded)
        value = np.where(np.isinf(most), 0.0, most)  # at the last place nothing follows
        steps_to.append(np.where(np.isinf(most), 0, skip + 1))
    places, at = [], last
    for t in range(count):
        forward = _at(steps_to[count - 1 - t], np.maximum(at, 0))
        at = np.where((at >= 0) & (forward > 0), at + forward, -1)
        places.append(at)
    return places, _at(value, last), np.where(places[0] >= 0, places[0] - last - 1, 0)


def _masked(f: np.ndarray, step: np.ndarray, coding: Coding, shape: tuple[int, int, int]) -> Record:
    """Values named by a mask, then a run of values at the end of the order."""
    dc_bits, ac_bits, most = shape
    order = np.array([0, *zigzag(8, 8)]) if coding.zigzag else np.arange(64)
    always = [int(np.nonzero(order == p)[0][0]) for p in IMPLICIT_PLACES] if coding.implicit else []
    free, best = most - len(always), None
    for k in range(4):
        q0, g0 = _stored(f[:1], step[:1] * SCALES[k], dc_bits)
        q, g = _stored(f[order], step[order] * SCALES[k], ac_bits)
        q, g = np.where(g > 0, q, 0), np.maximum(g, 0)
        for chosen in range(free + 1):
            start = 64 - free + chosen  # first rank of the run
            ranks = np.array([r for r in range(1, min(63, start)) if r not in always])
            if len(ranks) < chosen:
                break
            top = np.sort(ranks[np.argsort(-g[ranks], kind="stable")[:chosen]])
            gain = float(g0[0] + g[always].sum() + g[top].sum() + g[start:].sum())
            if best is None or gain > best.gain:
                mask = [(int(r in set(top)), 1) for r in range(1, 63) if r not in always]
                values = [(int(q[r]), ac_bits) for r in [*[always[IMPLICIT_PLACES.index(p)] for p in IMPLICIT_PLACES if always], *top, *range(start, 64)]]
                best = Record([*mask, (k, 2), (int(q0[0]), dc_bits), *values], gain, True)
    return best


#: Vectors whose forms are looked for at once, a bound on memory: some dozens of arrays of them, 8 scales and 256 places at most.
AT_ONCE = 128


def choose(f: np.ndarray, w: int, h: int, size: int, quality: int, chroma: bool, coding: Coding, allow_skip: bool = True) -> Record:
    """The record of least error; a plain form wins over skips unless these are strictly better."""
    step, shape = steps(w, h, quality, chroma), masked_shape(coding, w, h, size)
    if shape:
        return _masked(f, step, coding, shape)
    plain = _plain(f[None], step, w, h, size, coding)
    if coding.skip and allow_skip:
        skips = _skips(f[None], step, w, h, size, coding)
        if skips.gain[0] > plain.gain[0]:
            return skips.one()
    return plain.one()


def written(f: np.ndarray, w: int, h: int, size: int, quality: int, chroma: bool, coding: Coding) -> np.ndarray:
    """(n, size) bytes: the record that ``choose`` finds for each vector (n, places), many at a time."""
    step, out = steps(w, h, quality, chroma), np.zeros((len(f), size), dtype=np.uint8)
    if masked_shape(coding, w, h, size):
        for k, v in enumerate(f):
            out[k] = np.frombuffer(write(choose(v, w, h, size, quality, chroma, coding), size), dtype=np.uint8)
        return out
    for a in range(0, len(f), AT_ONCE):
        part = f[a : a + AT_ONCE]
        plain = _plain(part, step, w, h, size, coding)
        out[a : a + AT_ONCE] = plain.packed(size)
        if coding.skip:
            skips = _skips(part, step, w, h, size, coding)
            up = skips.gain > plain.gain
            out[a : a + AT_ONCE][up] = skips.packed(size)[up]
    return out


def written_with_library(f: np.ndarray, prototypes: list[np.ndarray], w: int, h: int, size: int, quality: int, chroma: bool, coding: Coding, reference: str, split: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, size) bytes: for each vector the best of the plain record and records relative to each prototype, and which it is (0: none)."""
    step, out, used = steps(w, h, quality, chroma), np.zeros((len(f), size), dtype=np.uint8), np.zeros(len(f), dtype=np.int64)
    for a in range(0, len(f), AT_ONCE):
        part, least = f[a : a + AT_ONCE], None
        for k in range(len(prototypes) + 1):
            rest = part - prototypes[k - 1] if k else part
            r = _plain(rest, step, w, h, size, coding, int(reference == "tail"), split if k else 0.0, 4 if reference == "header" else 99, k << 2 if reference == "header" else 0)
            if reference == "tail":
                r = Records(np.column_stack([r.values, np.full(len(part), k)]), [*r.bits, coding.bits], r.gain)
            error = (rest**2).sum(axis=1) - r.gain
            up = np.ones(len(part), dtype=bool) if least is None else error < least
            least = error if least is None else np.where(up, error, least)
            out[a : a + AT_ONCE][up], used[a : a + AT_ONCE][up] = r.packed(size)[up], k
    return out, used


def write(record: Record, size: int) -> bytes:
    """The bytes of a record, padded with zeros."""
    total, at = 0, 0
    if record.low_first:
        for value, bits in record.fields:
            total |= (value & (1 << bits) - 1) << at
            at += bits
        return total.to_bytes(size, "little")
    for value, bits in record.fields:
        total = total << bits | value & (1 << bits) - 1
        at += bits
    return (total << size * 8 - at).to_bytes(size, "big")


class _Fields:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, bits: int) -> int:
        self.left -= bits
        if self.left < 0:
            raise ValueError("truncated record")
        return self.value >> self.left & (1 << bits) - 1

    def signed(self, bits: int) -> int:
        v = self.take(bits)
        return v - (1 << bits) if v >> bits - 1 else v


def _read_masked(data: bytes, step: np.ndarray, coding: Coding, shape: tuple[int, int, int]) -> np.ndarray:
    dc_bits, ac_bits, most = shape
    order = [0, *zigzag(8, 8)] if coding.zigzag else list(range(64))
    always = [order.index(p) for p in IMPLICIT_PLACES] if coding.implicit else []
    at, top = 0, []
    for r in range(1, 63):
        if r not in always:
            if low_field_at(data, at, 1):
                top.append(r)
            at += 1
    scale = SCALES[low_field_at(data, at, 2)]
    start = 64 - (most - len(always) - len(top))
    if start > 64 or any(r >= start for r in top):
        raise ValueError("bad mask")
    f, at = np.zeros(64), at + 2
    for r, bits in [(0, dc_bits), *((r, ac_bits) for r in [*always, *top, *range(start, 64)])]:
        v = low_field_at(data, at, bits)
        f[order[r]] = (v - (1 << bits) if v >> bits - 1 else v) * step[order[r]] * scale
        at += bits
    return f


def read(data: bytes, w: int, h: int, quality: int, chroma: bool, coding: Coding, prototypes: list[np.ndarray] = (), reference: str | None = None, split: float = 0.0, index: int = 0) -> np.ndarray:
    """The coefficients of a record; ``index`` names its prototype where that is stored beside it."""
    step, shape = steps(w, h, quality, chroma), masked_shape(coding, w, h, len(data))
    if shape:
        return _read_masked(data, step, coding, shape)
    get, f = _Fields(data), np.zeros(w * h)
    profile, scale = get.take(4), get.take(4)
    skip = bool(coding.skip and scale & 8)
    if reference == "header":
        profile, index = profile & 3, profile >> 2
    if profile >= profiles(coding, skip) or (not skip and scale >= 8) or (skip and reference):
        raise ValueError("bad profile")
    scale &= 7
    f[0] = get.signed(10) * step[0] * SCALES[scale]
    if skip:
        tokens, coarse, tail = skip_layout(len(data), w, h, coding.skip)
        at, place, fine = profile_scan(coding, profile, w, h, True), 0, SCALES[1 if scale >= 3 else 0]
        for t in range(tokens):
            if place >= len(at):
                raise ValueError("bad skip")
            f[at[place]] = get.signed(6 if t < coarse else 4) * step[at[place]] * (SCALES[scale] if t < coarse else fine)
            place += get.take(2) + 1
        for t in range(tail):
            v = get.signed(4)
            if place < len(at):
                f[at[place]] = v * step[at[place]] * fine
            elif v:
                raise ValueError("bad skip")
            if t + 1 < tail:
                place += get.take(2) + 1
        return f
    count = ac_count(coding, len(data), w * h - 1, int(reference == "tail"))
    full = profile_scan(coding, profile, w, h)
    scales = [SCALES[get.take(3)] for _ in range(coding.groups)] or [SCALES[scale]]
    ends = group_ends(coding, count) if coding.groups else [count]
    values = [get.signed(coding.bits) for _ in range(count)]
    if reference == "tail":
        index = get.take(coding.bits)
    at = split_scan(full, count, split if index else 0.0)
    for (a, b), s in zip(zip([0, *ends], ends), scales, strict=False):
        f[at[a:b]] = np.array(values[a:b]) * step[at[a:b]] * s
    if index > len(prototypes):
        raise ValueError("bad prototype")
    return f + prototypes[index - 1] if index else f
