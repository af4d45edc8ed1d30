"""Four by four block textures (BC1, and BC7 in its mode 6), all blocks of a batch at a time."""

from __future__ import annotations

import numpy as np

# Weights of BC7's sixteen steps, and search passes by effort.
WEIGHTS = np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64])
PASSES = {"fast": 1, "balanced": 3, "thorough": 6}


def blocks_of(rgba: np.ndarray) -> np.ndarray:
    """(blocks, 16, channels) of an image, its edges repeated."""
    h, w, k = rgba.shape
    down, across = -(-h // 4), -(-w // 4)
    full = rgba[np.minimum(np.arange(down * 4), h - 1)][:, np.minimum(np.arange(across * 4), w - 1)]
    return full.reshape(down, 4, across, 4, k).swapaxes(1, 2).reshape(-1, 16, k)


def image_of(blocks: np.ndarray, height: int, width: int) -> np.ndarray:
    down, across = -(-height // 4), -(-width // 4)
    k = blocks.shape[-1]
    return blocks.reshape(down, across, 4, 4, k).swapaxes(1, 2).reshape(down * 4, across * 4, k)[:height, :width]


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def principal_ends(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the blocks' colours along their main axis, found by eight power steps; the mean of flat blocks."""
    mean = p.mean(axis=1, keepdims=True)
    d = p - mean
    covariance = np.einsum("nia,nib->nab", d, d)
    axis = np.full((len(p), p.shape[2]), 1 / np.sqrt(p.shape[2]))
    moving = np.ones(len(p), dtype=bool)
    for _ in range(8):
        new = np.einsum("nab,nb->na", covariance, axis)
        length = np.sqrt((new**2).sum(axis=1))
        moving &= length >= 1e-8
        axis = np.where(moving[:, None], new / np.where(moving, length, 1)[:, None], axis)
    along = np.einsum("nia,na->ni", d, axis)
    low, high = along.min(axis=1), along.max(axis=1)
    flat = (high - low < 1e-5)[:, None]
    ends = [np.where(flat, mean[:, 0], np.clip(half_up(mean[:, 0] + axis * t[:, None]), 0, 255)) for t in (low, high)]
    return ends[0], ends[1]


def pack565(rgb: np.ndarray) -> np.ndarray:
    v = half_up(rgb[:, :3] * [31, 63, 31] / 255).astype(np.int64)
    return v[:, 0] << 11 | v[:, 1] << 5 | v[:, 2]


def unpack565(code: np.ndarray) -> np.ndarray:
    r, g, b = code >> 11 & 31, code >> 5 & 63, code & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=-1)


def bc1_palette(c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """(blocks, 4, 4): two ends and two steps between, or one step and transparent where c0 <= c1."""
    a, b = unpack565(c0), unpack565(c1)
    four = (c0 > c1)[:, None]
    third = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    last = np.where(four, (a + 2 * b) // 3, 0)
    rgb = np.stack([a, b, third, last], axis=1)
    alpha = np.full(rgb.shape[:2] + (1,), 255)
    alpha[:, 3, 0] = np.where(four[:, 0], 255, 0)
    return np.concatenate([rgb, alpha], axis=2)


def _bc1_fit(p: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ((p[:, :, None, :3] - bc1_palette(c0, c1)[:, None, :, :3]) ** 2).sum(axis=-1)
    return d.argmin(axis=2), d.min(axis=2).sum(axis=1)


def encode_bc1(p: np.ndarray, effort: str = "balanced") -> np.ndarray:
    """(blocks, 8) bytes of blocks (n, 16, 3 or 4)."""
    p = p.astype(np.int64)
    low, high = principal_ends(p[:, :, :3].astype(np.float64))
    a, b = pack565(high), pack565(low)
    c0, c1 = np.maximum(a, b), np.minimum(a, b)
    same = c0 == c1
    c0 = np.where(same, np.minimum(0xFFFF, c0 + 1), c0)
    c1 = np.where(c0 <= c1, np.maximum(0, c1 - 1), c1)
    slots, error = _bc1_fit(p, c0, c1)
    open_ = np.ones(len(p), dtype=bool)
    for _ in range(PASSES[effort]):
        changed = np.zeros(len(p), dtype=bool)
        for end in (0, 1):
            for step in (-2048, 2048, -32, 32, -1, 1):
                t0 = np.clip(c0 + step, 0, 0xFFFF) if end == 0 else c0
                t1 = np.clip(c1 + step, 0, 0xFFFF) if end == 1 else c1
                s, e = _bc1_fit(p, t0, t1)
                better = open_ & (t0 > t1) & (e < error)
                c0, c1, error = np.where(better, t0, c0), np.where(better, t1, c1), np.where(better, e, error)
                slots = np.where(better[:, None], s, slots)
                changed |= better
        open_ &= changed
        if not open_.any():
            break
    word = (slots << (2 * np.arange(16))).sum(axis=1)
    return np.concatenate([np.stack([c0, c1], axis=1).astype("<u2").view(np.uint8), word.astype("<u4")[:, None].view(np.uint8)], axis=1)


def inspect_bc1(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two colour codes and the sixteen slots of each block (n, 8)."""
    ends = np.ascontiguousarray(data[:, :4]).view("<u2").astype(np.int64)
    word = np.ascontiguousarray(data[:, 4:]).view("<u4").astype(np.int64)
    return ends[:, 0], ends[:, 1], word >> (2 * np.arange(16)) & 3


def decode_bc1(data: np.ndarray) -> np.ndarray:
    c0, c1, slots = inspect_bc1(data)
    return np.take_along_axis(bc1_palette(c0, c1), slots[:, :, None], axis=1).astype(np.uint8)


def _bc7_steps(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low[:, None, :] * (64 - WEIGHTS)[:, None] + high[:, None, :] * WEIGHTS[:, None] + 32) >> 6


def _bc7_end(color: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seven stored bits, the shared low bit and the resulting colour nearest to one."""
    tries = []
    for bit in (0, 1):
        stored = np.clip(half_up((color - bit) / 2), 0, 127).astype(np.int64)
        back = stored << 1 | bit
        tries.append((stored, back, ((back - color) ** 2).sum(axis=1)))
    one = tries[1][2] < tries[0][2]
    return np.where(one[:, None], tries[1][0], tries[0][0]), one.astype(np.int64), np.where(one[:, None], tries[1][1], tries[0][1])


def _bc7_slots(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return ((p[:, :, None, :] - _bc7_steps(low, high)[:, None]) ** 2).sum(axis=-1).argmin(axis=2)


def _refit(p: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares ends for given slots; the principal ends where these do not determine them."""
    b = WEIGHTS[slots] / 64
    a = 1 - b
    aa, ab, bb = (a * a).sum(axis=1), (a * b).sum(axis=1), (b * b).sum(axis=1)
    det = aa * bb - ab * ab
    ap, bp = np.einsum("ni,nik->nk", a, p), np.einsum("ni,nik->nk", b, p)
    open_ = np.abs(det) < 1e-8
    safe = np.where(open_, 1, det)[:, None]
    low = np.clip(half_up((ap * bb[:, None] - bp * ab[:, None]) / safe), 0, 255)
    high = np.clip(half_up((bp * aa[:, None] - ap * ab[:, None]) / safe), 0, 255)
    if open_.any():
        low[open_], high[open_] = principal_ends(p[open_].astype(np.float64))
    return low, high


def encode_bc7(p: np.ndarray, effort: str = "balanced") -> np.ndarray:
    """(blocks, 16) bytes of blocks (n, 16, 4), in mode 6."""
    p = p.astype(np.int64)
    ends = [list(_bc7_end(e)) for e in principal_ends(p.astype(np.float64))]
    slots = _bc7_slots(p, ends[0][2], ends[1][2])
    open_ = np.ones(len(p), dtype=bool)
    for _ in range(PASSES[effort]):
        new = [_bc7_end(e) for e in _refit(p, slots)]
        fresh = _bc7_slots(p, new[0][2], new[1][2])
        same = (fresh == slots).all(axis=1) & (new[0][2] == ends[0][2]).all(axis=1) & (new[1][2] == ends[1][2]).all(axis=1)
        open_ &= ~same
        for k in (0, 1):
            for field in range(3):
                pick = open_ if new[k][field].ndim == 1 else open_[:, None]
                ends[k][field] = np.where(pick, new[k][field], ends[k][field])
        slots = np.where(open_[:, None], fresh, slots)
        if not open_.any():
            break
    swap = slots[:, 0] >= 8
    slots = np.where(swap[:, None], 15 - slots, slots)
    low, high = (np.where(swap[:, None], ends[1 - k][0], ends[k][0]) for k in (0, 1))
    low_bit, high_bit = (np.where(swap, ends[1 - k][1], ends[k][1]) for k in (0, 1))
    columns = [(np.full(len(p), 64), 7)] + [(e[:, c], 7) for c in range(4) for e in (low, high)] + [(low_bit, 1), (high_bit, 1)] + [(slots[:, i], 3 if i == 0 else 4) for i in range(16)]
    bits = np.concatenate([(v[:, None] >> np.arange(w)) & 1 for v, w in columns], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little")


def inspect_bc7(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ends and the sixteen slots of each block (n, 16)."""
    bits = np.unpackbits(data, axis=1, bitorder="little").astype(np.int64)
    take = lambda at, w: bits[:, at : at + w] @ (1 << np.arange(w))
    if (take(0, 7) != 64).any():
        raise ValueError("only mode 6 is supported")
    stored = np.stack([take(7 + 7 * k, 7) for k in range(8)], axis=1).reshape(-1, 4, 2)
    low, high = (stored[:, :, k] << 1 | take(63 + k, 1)[:, None] for k in (0, 1))
    slots = np.stack([take(65, 3)] + [take(68 + 4 * i, 4) for i in range(15)], axis=1)
    return low, high, slots


def decode_bc7(data: np.ndarray) -> np.ndarray:
    low, high, slots = inspect_bc7(data)
    return np.take_along_axis(_bc7_steps(low, high), slots[:, :, None], axis=1).astype(np.uint8)
