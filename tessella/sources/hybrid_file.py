"""Hybrid images: every 16 by 16 unit is either a palette record or a transform record."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessella.functions.coding import CHROMA_TABLE, LUMA_TABLE, scaled_table, zigzag
from tessella.operators.transform import forward_fixed, inverse_fixed, rounded
from tessella.sources.bits import Reader, Writer, log2, put_golomb, put_signed_golomb
from tessella.sources.palette_file import PaletteImage, put_colors, take_colors

# Magic, version, unit size, mode numbers and header layout.
MAGIC, VERSION, UNIT = b"BPDH", 1, 16
PALETTE, TRANSFORM = 0, 1
HEAD = struct.Struct("<4sBBBBIIBBBBIIIIIII")
#: 16-bit fixed-point colour transform, as in functions.color.
_YCC = np.array([[19595, 38470, 7471], [-11059, -21709, 32768], [32768, -27439, -5329]])
ORDER = np.array([0, *zigzag(8, 8)])


@dataclass
class HybridImage:
    width: int
    height: int
    modes: np.ndarray  # (units,)
    palette: PaletteImage | None  # with block 16; its records count where the mode is palette
    tables: np.ndarray | None  # (2, 64) luma and chroma quantisation
    blocks: np.ndarray | None  # (units, 6, 64) quantised coefficients

    @property
    def across(self) -> int:
        return -(-self.width // UNIT)

    def check(self) -> None:
        units = self.across * -(-self.height // UNIT)
        if self.modes.shape != (units,) or not np.isin(self.modes, (0, 1)).all():
            raise ValueError("bad modes")
        if (self.modes == PALETTE).any():
            if self.palette is None or self.palette.block != UNIT or (self.palette.width, self.palette.height) != (self.width, self.height):
                raise ValueError("bad palette part")
            self.palette.check()
        if (self.modes == TRANSFORM).any():
            if self.blocks is None or self.blocks.shape != (units, 6, 64) or np.abs(self.blocks).max(initial=0) > 32768 or self.blocks.max(initial=0) > 32767:
                raise ValueError("bad coefficients")
            if self.tables is None or self.tables.shape != (2, 64) or self.tables.min() < 1 or self.tables.max() > 255:
                raise ValueError("bad quantisation tables")


def unit_planes(rgb: np.ndarray) -> np.ndarray:
    """(units, 6, 8, 8) samples: four luma blocks and two chroma blocks at half size, edges repeated."""
    h, w = rgb.shape[:2]
    down, across = -(-h // UNIT), -(-w // UNIT)
    full = rgb[np.minimum(np.arange(down * UNIT), h - 1)][:, np.minimum(np.arange(across * UNIT), w - 1)].astype(np.int64)
    ycc = np.clip(rounded(full @ _YCC.T, 65536) + [0, 128, 128], 0, 255)
    tiles = ycc.reshape(down, UNIT, across, UNIT, 3).swapaxes(1, 2).reshape(-1, UNIT, UNIT, 3)
    luma = tiles[..., 0].reshape(-1, 2, 8, 2, 8).swapaxes(2, 3).reshape(-1, 4, 8, 8)
    chroma = rounded(tiles[..., 1:].reshape(-1, 8, 2, 8, 2, 2).sum(axis=(2, 4)), 4).transpose(0, 3, 1, 2)
    return np.concatenate([luma, chroma], axis=1)


def transformed(rgb: np.ndarray) -> np.ndarray:
    """(units, 6, 64) integer coefficients."""
    planes = unit_planes(rgb)
    return forward_fixed(planes.reshape(-1, 8, 8)).reshape(-1, 6, 64)


def quality_tables(quality: int) -> np.ndarray:
    return np.array([scaled_table(LUMA_TABLE, quality), scaled_table(CHROMA_TABLE, quality)])


def quantise(coefficients: np.ndarray, tables: np.ndarray) -> np.ndarray:
    per_block = tables[[0, 0, 0, 0, 1, 1]]
    return np.clip(rounded(coefficients, per_block[None]), -32768, 32767)


def _upsampled(plane: np.ndarray) -> np.ndarray:
    """(n, 16, 16) from (n, 8, 8): bilinear, centre-aligned, within the unit."""
    at = np.arange(UNIT)
    low = at // 2 - (at % 2 == 0)
    w = np.where(at % 2 == 0, 3, 1)
    a, b = np.clip(low, 0, 7), np.clip(low + 1, 0, 7)
    rows = plane[:, :, a] * (4 - w) + plane[:, :, b] * w
    return rounded(rows[:, a, :] * (4 - w)[:, None] + rows[:, b, :] * w[:, None], 16)


def unit_pixels(blocks: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(n, 16, 16, 3) bytes of transform units."""
    back = blocks.astype(np.int64) * tables[[0, 0, 0, 0, 1, 1]][None]
    planes = np.clip(inverse_fixed(back.reshape(-1, 8, 8)), 0, 255).reshape(-1, 6, 8, 8)
    y = planes[:, :4].reshape(-1, 2, 2, 8, 8).swapaxes(2, 3).reshape(-1, UNIT, UNIT)
    u, v = _upsampled(planes[:, 4]) - 128, _upsampled(planes[:, 5]) - 128
    rgb = np.stack([y + rounded(91881 * v, 65536), y + rounded(-22554 * u - 46802 * v, 65536), y + rounded(116130 * u, 65536)], axis=-1)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def block_bits(block: np.ndarray) -> int:
    """Bits of one block of quantised coefficients."""
    out = Writer()
    _put_block(out, block)
    return out.bits


def _put_block(out: Writer, block: np.ndarray) -> None:
    along = block[ORDER]
    put_signed_golomb(out, int(along[0]))
    before = 0
    for k in np.nonzero(along[1:])[0] + 1:
        out.put(0, 1)
        put_golomb(out, int(k - before - 1))
        put_signed_golomb(out, int(along[k]))
        before = k
    out.put(1, 1)


def encode(image: HybridImage) -> bytes:
    image.check()
    has = [bool((image.modes == m).any()) for m in (PALETTE, TRANSFORM)]
    palette, records, coefficients = Writer(), Writer(), Writer()
    p = image.palette
    if has[PALETTE]:
        put_colors(palette, p.palette.reshape(-1, 3), p.color_bits)
        for unit in np.nonzero(image.modes == PALETTE)[0]:
            ys, xs = slice(unit // image.across * UNIT, (unit // image.across + 1) * UNIT), slice(unit % image.across * UNIT, (unit % image.across + 1) * UNIT)
            records.put(p.selectors[unit], log2(p.palettes)).put(p.table[unit], log2(p.shared)).put(p.slots()[ys, xs].ravel(), log2(p.local))
    tables = image.tables.astype(np.uint8).tobytes() if has[TRANSFORM] else b""
    if has[TRANSFORM]:
        for unit in np.nonzero(image.modes == TRANSFORM)[0]:
            for block in image.blocks[unit]:
                _put_block(coefficients, block)
    modes = Writer().put(image.modes, 1).bytes() if all(has) else b""
    parts = [palette.bytes(), tables, modes, records.bytes(), coefficients.bytes()]
    counts = (log2(p.local), log2(p.shared), log2(p.palettes), p.color_bits) if has[PALETTE] else (0, 0, 0, 24)
    head = HEAD.pack(MAGIC, VERSION, has[0] | has[1] << 1, log2(UNIT), 0, image.width, image.height, *counts, len(parts[0]), len(modes), len(parts[3]), records.bits, len(tables), len(parts[4]), coefficients.bits)
    return head + b"".join(parts)


def decode(data: bytes) -> HybridImage:
    if len(data) < HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a hybrid image")
    _, version, flags, exponent, reserved, width, height, slot_bits, idx_bits, pal_bits, color_bits, palette_n, modes_n, records_n, record_bits, tables_n, coefficient_n, coefficient_bits = HEAD.unpack_from(data)
    if version != VERSION or not 0 < flags < 4 or 1 << exponent != UNIT or reserved or not (width and height) or color_bits not in (16, 24):
        raise ValueError("unsupported header")
    across, units = -(-width // UNIT), -(-width // UNIT) * -(-height // UNIT)
    ends = np.cumsum([HEAD.size, palette_n, tables_n, modes_n, records_n, coefficient_n])
    if len(data) != ends[-1] or records_n != -(-record_bits // 8) or coefficient_n != -(-coefficient_bits // 8) or modes_n != (-(-units // 8) if flags == 3 else 0) or tables_n != (128 if flags & 2 else 0):
        raise ValueError("the sizes of the sections do not match")
    palette_raw, tables_raw, modes_raw, records_raw, coefficients_raw = (data[a:b] for a, b in zip(ends, ends[1:]))
    modes = Reader(modes_raw).take(units, 1) if flags == 3 else np.full(units, flags - 1)
    palette = tables = blocks = None
    if flags & 1:
        colors = take_colors(Reader(palette_raw), 1 << idx_bits + pal_bits, color_bits).reshape(1 << pal_bits, 1 << idx_bits, 3)
        palette = PaletteImage(width, height, UNIT, colors, np.zeros(units, dtype=np.int64), np.zeros((units, 1 << slot_bits), dtype=np.int64), np.zeros((height, width), dtype=np.int64), color_bits)
        read = Reader(records_raw)
        for unit in np.nonzero(modes == PALETTE)[0]:
            ys, xs = slice(unit // across * UNIT, (unit // across + 1) * UNIT), slice(unit % across * UNIT, (unit % across + 1) * UNIT)
            palette.selectors[unit] = read.one(pal_bits)
            palette.table[unit] = read.take(1 << slot_bits, idx_bits)
            shape = palette.indices[ys, xs].shape
            palette.indices[ys, xs] = read.take(shape[0] * shape[1], slot_bits).reshape(shape)
        if read.at != record_bits:
            raise ValueError("bad palette records")
    if flags & 2:
        tables = np.frombuffer(tables_raw, dtype=np.uint8).reshape(2, 64).astype(np.int64)
        if tables.min() < 1:
            raise ValueError("bad quantisation tables")
        blocks, read = np.zeros((units, 6, 64), dtype=np.int64), Reader(coefficients_raw)
        for unit in np.nonzero(modes == TRANSFORM)[0]:
            for block in blocks[unit]:
                along, at = np.zeros(64, dtype=np.int64), 0
                along[0] = read.signed_golomb()
                while read.one(1) == 0:
                    at += read.golomb() + 1
                    if at > 63:
                        raise ValueError("bad coefficients")
                    along[at] = read.signed_golomb()
                block[ORDER] = along
        if read.at != coefficient_bits:
            raise ValueError("bad transform records")
    return HybridImage(width, height, modes, palette, tables, blocks)


def pixels(image: HybridImage) -> np.ndarray:
    """(height, width, 3) bytes."""
    down = len(image.modes) // image.across
    out = np.zeros((down, image.across, UNIT, UNIT, 3), dtype=np.uint8).reshape(-1, UNIT, UNIT, 3)
    chosen = image.modes == TRANSFORM
    if chosen.any():
        out[chosen] = unit_pixels(image.blocks[chosen], image.tables)
    full = out.reshape(down, image.across, UNIT, UNIT, 3).swapaxes(1, 2).reshape(down * UNIT, -1, 3)[: image.height, : image.width].copy()
    if (~chosen).any():
        at = np.arange(image.height)[:, None] // UNIT * image.across + np.arange(image.width)[None, :] // UNIT
        mine = ~chosen[at]
        full[mine] = image.palette.pixels()[mine]
    return full


def sample(image: HybridImage, x: int, y: int) -> tuple[int, int, int]:
    """The colour of one pixel, from its unit alone."""
    if not (0 <= x < image.width and 0 <= y < image.height):
        raise ValueError("pixel out of range")
    unit = y // UNIT * image.across + x // UNIT
    if image.modes[unit] == TRANSFORM:
        return tuple(map(int, unit_pixels(image.blocks[[unit]], image.tables)[0, y % UNIT, x % UNIT]))
    p = image.palette
    return tuple(map(int, p.palette[p.selectors[unit], p.table[unit, p.indices[y, x]]]))
