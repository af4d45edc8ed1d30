"""Palette images whose 64 by 64 tiles each choose a block size of 4, 8, 16 or 32."""

from __future__ import annotations

import struct

import numpy as np

from tessella.sources.bits import Reader, Writer, field_at, log2
from tessella.sources.palette_file import PaletteImage, from_565, put_colors, take_colors

# Magic, version, tile and block sizes, header layout.
MAGIC, VERSION, TILE = b"BPAV", 1, 64
SIZES = (4, 8, 16, 32)
HEAD = struct.Struct("<4sBBBBBBBBIIIII")


def _tiles(width: int, height: int) -> tuple[int, int]:
    return -(-width // TILE), -(-height // TILE)


def _tile_blocks(width: int, height: int, tile: int, size: int) -> np.ndarray:
    """Numbers, in the image's own grid of blocks, of the blocks of a tile."""
    tx, ty = tile % _tiles(width, height)[0], tile // _tiles(width, height)[0]
    xs = np.arange(tx * TILE // size, -(-min(width, (tx + 1) * TILE) // size))
    ys = np.arange(ty * TILE // size, -(-min(height, (ty + 1) * TILE) // size))
    return (ys[:, None] * -(-width // size) + xs[None, :]).ravel()


def check(candidates: list[PaletteImage], modes: list[int]) -> None:
    """The four candidates must be one image at block sizes 4 to 32, with equal counts, and each tile must name one."""
    shapes = {(c.width, c.height, c.local, c.shared, c.palettes, c.color_bits) for c in candidates}
    if [c.block for c in candidates] != list(SIZES) or len(shapes) != 1:
        raise ValueError("candidates do not match")
    across, down = _tiles(candidates[0].width, candidates[0].height)
    if len(modes) != across * down or any(m not in range(4) for m in modes):
        raise ValueError("bad tile modes")
    for m in set(modes):
        candidates[m].check()


def encode(candidates: list[PaletteImage], modes: list[int]) -> bytes:
    """candidates: the image at block sizes 4, 8, 16 and 32; modes: which of them each tile uses."""
    check(candidates, modes)
    first = candidates[0]
    used = sorted(set(modes))
    colors = Writer()
    for m in used:
        put_colors(colors, candidates[m].palette.reshape(-1, 3), first.color_bits)
    palette = colors.bytes()
    palette += bytes(-len(palette) % 4)
    directory, stream, at = [], [], 0
    for tile, m in enumerate(modes):
        c = candidates[m]
        blocks = _tile_blocks(c.width, c.height, tile, c.block)
        widths = [log2(c.palettes)] + [log2(c.shared)] * c.local
        fields = np.concatenate([c.selectors[blocks, None], c.table[blocks]], axis=1)
        bits = np.concatenate([(fields[:, [k]] >> np.arange(w - 1, -1, -1)) & 1 for k, w in enumerate(widths)], axis=1)
        part = Writer().put(bits.ravel(), 1).bytes()
        directory.append(m << 30 | at)
        stream.append(part)
        at += len(part)
    if at >= 1 << 30:
        raise ValueError("too many blocks")
    ty, tx = np.arange(first.height) // TILE, np.arange(first.width) // TILE
    mode_of = np.asarray(modes)[ty[:, None] * _tiles(first.width, first.height)[0] + tx[None, :]]
    indices = np.select([mode_of == m for m in used], [candidates[m].indices for m in used])
    pixels = Writer().put(indices.ravel(), log2(first.local)).bytes()
    raw = HEAD.size + len(palette) + 4 * len(modes) + at + len(pixels)
    head = HEAD.pack(MAGIC, VERSION, log2(TILE), log2(first.local), log2(first.shared), log2(first.palettes), first.color_bits, sum(1 << m for m in used), 0, first.width, first.height, at, raw, 0)
    return head + palette + struct.pack(f"<{len(modes)}I", *directory) + b"".join(stream) + pixels + bytes(-raw % 4)


class Adaptive:
    """An opened file; colours are read by coordinate."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size or data[:4] != MAGIC:
            raise ValueError("not an adaptive image")
        _, version, tile, self.slot_bits, self.idx_bits, self.pal_bits, self.color_bits, mask, flags, self.width, self.height, stream, raw, reserved = HEAD.unpack_from(data)
        if version != VERSION or 1 << tile != TILE or flags or reserved or self.color_bits not in (16, 24) or not 0 < mask < 16:
            raise ValueError("unsupported header")
        self.data, self.modes = data, [m for m in range(4) if mask >> m & 1]
        across, down = _tiles(self.width, self.height)
        one = (1 << self.pal_bits + self.idx_bits) * self.color_bits // 8
        self.palette_at = {m: HEAD.size + k * one for k, m in enumerate(self.modes)}
        self.directory_at = HEAD.size + (len(self.modes) * one + 3) // 4 * 4
        self.stream_at = self.directory_at + 4 * across * down
        self.pixels_at = self.stream_at + stream
        if raw != self.pixels_at + -(-self.width * self.height * self.slot_bits // 8) or len(data) != (raw + 3) // 4 * 4 or any(data[raw:]):
            raise ValueError("the size of the file does not match its header")
        self.directory = struct.unpack_from(f"<{across * down}I", data, self.directory_at)
        if any(e >> 30 not in self.modes or e & (1 << 30) - 1 > stream for e in self.directory):
            raise ValueError("bad tile directory")

    def sample(self, x: int, y: int) -> tuple[int, int, int]:
        if not (0 <= x < self.width and 0 <= y < self.height):
            raise ValueError("pixel out of range")
        across = _tiles(self.width, self.height)[0]
        entry = self.directory[y // TILE * across + x // TILE]
        size = SIZES[entry >> 30]
        row = -(-min(TILE, self.width - x // TILE * TILE) // size)
        block = y % TILE // size * row + x % TILE // size
        bits = self.pal_bits + (1 << self.slot_bits) * self.idx_bits
        start = (self.stream_at + (entry & (1 << 30) - 1)) * 8 + block * bits
        slot = field_at(self.data, self.pixels_at * 8 + (y * self.width + x) * self.slot_bits, self.slot_bits)
        pal = field_at(self.data, start, self.pal_bits)
        idx = field_at(self.data, start + self.pal_bits + slot * self.idx_bits, self.idx_bits)
        code = field_at(self.data, self.palette_at[entry >> 30] * 8 + ((pal << self.idx_bits) + idx) * self.color_bits, self.color_bits)
        return tuple(map(int, from_565(np.array(code)))) if self.color_bits == 16 else (code >> 16, code >> 8 & 255, code & 255)

    def pixels(self) -> np.ndarray:
        """The whole image, tile by tile."""
        across = _tiles(self.width, self.height)[0]
        slots = Reader(self.data, self.pixels_at * 8).take(self.width * self.height, self.slot_bits).reshape(self.height, self.width)
        out = np.zeros((self.height, self.width, 3), dtype=np.uint8)
        palettes = {m: take_colors(Reader(self.data, at * 8), 1 << self.pal_bits + self.idx_bits, self.color_bits) for m, at in self.palette_at.items()}
        for tile, entry in enumerate(self.directory):
            size = SIZES[entry >> 30]
            ys, xs = slice(tile // across * TILE, (tile // across + 1) * TILE), slice(tile % across * TILE, (tile % across + 1) * TILE)
            own = slots[ys, xs]
            row, column = -(-own.shape[1] // size), -(-own.shape[0] // size)
            bits = self.pal_bits + (1 << self.slot_bits) * self.idx_bits
            raw = Reader(self.data, (self.stream_at + (entry & (1 << 30) - 1)) * 8).take(row * column * bits, 1).reshape(row * column, bits)
            pal = raw[:, : self.pal_bits] @ (1 << np.arange(self.pal_bits - 1, -1, -1)) if self.pal_bits else np.zeros(row * column, dtype=np.int64)
            table = raw[:, self.pal_bits :].reshape(row * column, -1, self.idx_bits) @ (1 << np.arange(self.idx_bits - 1, -1, -1))
            block = np.arange(own.shape[0])[:, None] // size * row + np.arange(own.shape[1])[None, :] // size
            out[ys, xs] = palettes[entry >> 30][(pal[block] << self.idx_bits) + table[block, own]]
        return out
