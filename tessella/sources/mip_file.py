"""Mip chains: a palette image, and smaller levels that share its palettes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessella.sources import palette_file
from tessella.sources.bits import Reader, Writer, log2

# Magic, version and header sizes.
MAGIC, VERSION = b"BPLM", 1
HEAD, LEVEL = struct.Struct("<4sBBHI"), struct.Struct("<IIHHI")


@dataclass
class Level:
    """One level; direct holds an index into all palettes for each pixel where block tables would save nothing."""

    width: int
    height: int
    block: int
    selectors: np.ndarray | None = None
    table: np.ndarray | None = None
    indices: np.ndarray | None = None
    direct: np.ndarray | None = None


def _local(base, block: int) -> int:
    return min(base.local, block * block)


def _check_step(before, level: Level) -> None:
    if (level.width, level.height, level.block) != (max(1, before.width // 2), max(1, before.height // 2), max(1, before.block // 2)):
        raise ValueError("a level is not half of the one before")


def encode(base: palette_file.PaletteImage, levels: list[Level]) -> bytes:
    body = palette_file.encode(base)
    out, before = [HEAD.pack(MAGIC, VERSION, len(levels) + 1, 0, len(body)), body], base
    for level in levels:
        _check_step(before, level)
        bits = Writer()
        if level.direct is not None:
            bits.put(level.direct.ravel(), log2(base.palettes) + log2(base.shared))
        else:
            bits.put(level.selectors, log2(base.palettes)).put(level.table.ravel(), log2(base.shared)).put(level.indices.ravel(), log2(_local(base, level.block)))
        payload = bits.bytes()
        out += [LEVEL.pack(level.width, level.height, level.block, 0, len(payload)), payload]
        before = level
    return b"".join(out)


def decode(data: bytes) -> tuple[palette_file.PaletteImage, list[Level]]:
    if len(data) < HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a mip chain")
    _, version, count, reserved, size = HEAD.unpack_from(data)
    if version != VERSION or reserved or not count:
        raise ValueError("unsupported version")
    base = palette_file.decode(data[HEAD.size : HEAD.size + size])
    at, levels, before = HEAD.size + size, [], base
    for _ in range(count - 1):
        if len(data) < at + LEVEL.size:
            raise ValueError("truncated file")
        width, height, block, reserved, size = LEVEL.unpack_from(data, at)
        level = Level(width, height, block)
        _check_step(before, level)
        read = Reader(data[at + LEVEL.size : at + LEVEL.size + size])
        local, blocks = _local(base, block), -(-width // block) * -(-height // block)
        if local == block * block:
            bits = width * height * (log2(base.palettes) + log2(base.shared))
        else:
            bits = blocks * (log2(base.palettes) + local * log2(base.shared)) + width * height * log2(local)
        if reserved or size != -(-bits // 8) or len(data) < at + LEVEL.size + size:
            raise ValueError("a level's size does not match its header")
        if local == block * block:
            level.direct = read.take(width * height, log2(base.palettes) + log2(base.shared)).reshape(height, width)
        else:
            level.selectors = read.take(blocks, log2(base.palettes))
            level.table = read.take(blocks * local, log2(base.shared)).reshape(blocks, local)
            level.indices = read.take(width * height, log2(local)).reshape(height, width)
        levels.append(level)
        at, before = at + LEVEL.size + size, level
    if at != len(data):
        raise ValueError("bytes after the last level")
    return base, levels


def level_pixels(base: palette_file.PaletteImage, level: Level) -> np.ndarray:
    flat = base.palette.reshape(-1, 3)
    if level.direct is not None:
        return flat[level.direct]
    across = -(-level.width // level.block)
    at = np.arange(level.height)[:, None] // level.block * across + np.arange(level.width)[None, :] // level.block
    return base.palette[level.selectors[at], level.table[at, level.indices]]


def halved(rgb: np.ndarray) -> np.ndarray:
    """The image at half size: means of 2 by 2 pixels in linear light, edges repeated, as bytes."""
    x = np.arange(256) / 255.0
    linear = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)[rgb]
    h, w = max(1, rgb.shape[0] // 2), max(1, rgb.shape[1] // 2)
    ys, xs = [np.minimum(np.arange(n)[:, None] * 2 + [0, 1], full - 1) for n, full in ((h, rgb.shape[0]), (w, rgb.shape[1]))]
    mean = linear[ys[:, None, :, None], xs[None, :, None, :]].mean(axis=(2, 3))
    out = np.where(mean <= 0.0031308, mean * 12.92, 1.055 * mean ** (1 / 2.4) - 0.055) * 255
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _nearest(points: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ((points[:, None, :] - palette[None]) ** 2).sum(axis=-1)
    return d.argmin(axis=1), d.min(axis=1)


def _linear(rgb: np.ndarray) -> np.ndarray:
    x = rgb / 255.0
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def build(base: palette_file.PaletteImage) -> list[Level]:
    """All levels down to one pixel, with the palettes of the base image.

    A block takes the palette with the least summed error, the first on ties;
    its table has the palette's most used entries, the lower index on ties.
    """
    levels, rgb, block = [], base.pixels(), base.block
    entries = [_linear(p.astype(np.float64)) for p in base.palette]
    while rgb.shape[0] > 1 or rgb.shape[1] > 1:
        rgb, block = halved(rgb), max(1, block // 2)
        height, width = rgb.shape[:2]
        points, local = _linear(rgb.astype(np.float64)), _local(base, block)
        level = Level(width, height, block)
        if local == block * block:
            level.direct = _nearest(points.reshape(-1, 3), np.concatenate(entries))[0].reshape(height, width)
        else:
            across, down = -(-width // block), -(-height // block)
            level.selectors, level.table = np.zeros(across * down, dtype=np.int64), np.zeros((across * down, local), dtype=np.int64)
            level.indices = np.zeros((height, width), dtype=np.int64)
            for b in range(across * down):
                ys, xs = slice(b // across * block, (b // across + 1) * block), slice(b % across * block, (b % across + 1) * block)
                own = points[ys, xs].reshape(-1, 3)
                found = [_nearest(own, e) for e in entries]
                pal = int(np.argmin([d.sum() for _, d in found]))
                used, counts = np.unique(found[pal][0], return_counts=True)
                top = used[np.lexsort((used, -counts))][:local]
                level.selectors[b] = pal
                level.table[b] = np.concatenate([top, np.full(local - len(top), top[0])])
                level.indices[ys, xs] = _nearest(own, entries[pal][level.table[b]])[0].reshape(points[ys, xs].shape[:2])
        levels.append(level)
    return levels
