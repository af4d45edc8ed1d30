"""Palette images: every block of pixels has a short table of entries of a shared palette.

The file has a 14-byte header and four bit sections: palettes, a palette number
for each block, a table for each block, and a table slot for each pixel. All
reads and writes are of whole sections; a single pixel is read from its own
fields alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessella.functions.color import FROM_LAB, FROM_LMS, LINEAR_BREAK, SRGB_BREAK, TO_LAB, TO_LMS
from tessella.sources.bits import Reader, Writer, field_at, log2

# Magic, version and limits of the file.
MAGIC, VERSION, HEADER = b"BPAL", 5, 14
LIMITS = {"block": (2, 256), "local": (2, 16), "shared": (2, 256), "palettes": (1, 128)}
PACKED = 1


@dataclass
class PaletteImage:
    width: int
    height: int
    block: int
    palette: np.ndarray  # (palettes, shared, 3) bytes
    selectors: np.ndarray  # (blocks,)
    table: np.ndarray  # (blocks, local)
    indices: np.ndarray | None = None  # (height, width); None if a block's table has an entry for each of its pixels
    color_bits: int = 24
    scalar: bool = False
    vectors: list = field(default_factory=list)

    @property
    def palettes(self) -> int:
        return self.palette.shape[0]

    @property
    def shared(self) -> int:
        return self.palette.shape[1]

    @property
    def local(self) -> int:
        return self.table.shape[1]

    @property
    def across(self) -> int:
        return -(-self.width // self.block)

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.block)

    @property
    def direct(self) -> bool:
        return self.local == self.block**2

    def check(self) -> None:
        """Raises ValueError unless every count, index and colour is in range."""
        if not (1 <= self.width <= 1 << 24 and 1 <= self.height <= 1 << 24):
            raise ValueError("bad dimensions")
        for name, (low, high) in LIMITS.items():
            n = getattr(self, name)
            log2(n, name)
            if not low <= n <= high:
                raise ValueError(f"{name} out of range")
        if self.local > self.shared or self.local > self.block**2:
            raise ValueError("more local colours than shared colours or pixels")
        if self.color_bits not in (16, 24) or (self.scalar and self.vectors):
            raise ValueError("bad colour mode")
        if self.selectors.shape != (self.blocks,) or self.table.shape[0] != self.blocks:
            raise ValueError("wrong number of blocks")
        parts = [(self.palette, 256), (self.selectors, self.palettes), (self.table, self.shared)]
        if not self.direct:
            if self.indices is None or self.indices.shape != (self.height, self.width):
                raise ValueError("wrong number of pixel indices")
            parts.append((self.indices, self.local))
        for values, top in parts:
            if values.size and (values.min() < 0 or values.max() >= top):
                raise ValueError("value out of range")

    def block_of(self) -> np.ndarray:
        y, x = np.arange(self.height)[:, None], np.arange(self.width)[None, :]
        return y // self.block * self.across + x // self.block

    def slots(self) -> np.ndarray:
        if self.indices is not None:
            return self.indices
        return np.arange(self.height)[:, None] % self.block * self.block + np.arange(self.width)[None, :] % self.block

    def pixels(self) -> np.ndarray:
        """(height, width, 3) bytes through slot, table and palette."""
        at = self.block_of()
        return self.palette[self.selectors[at], self.table[at, self.slots()]]


def to_565(rgb: np.ndarray) -> np.ndarray:
    v = np.floor(rgb.astype(np.float64) * [31, 63, 31] / 255 + 0.5).astype(np.int64)
    return v[..., 0] << 11 | v[..., 1] << 5 | v[..., 2]


def from_565(code: np.ndarray) -> np.ndarray:
    v = np.stack([code >> 11 & 31, code >> 5 & 63, code & 31], axis=-1)
    return np.floor(v * 255 / np.array([31.0, 63.0, 31.0]) + 0.5).astype(np.uint8)


def stored_colors(rgb: np.ndarray, color_bits: int) -> np.ndarray:
    """Colours as the file will give them back."""
    return from_565(to_565(rgb)) if color_bits == 16 else rgb.astype(np.uint8)


def put_colors(out: Writer, rgb: np.ndarray, color_bits: int) -> None:
    if color_bits == 16:
        out.put(to_565(rgb).ravel(), 16)
    else:
        out.put(rgb.ravel(), 8)


def take_colors(data: Reader, count: int, color_bits: int) -> np.ndarray:
    return from_565(data.take(count, 16)) if color_bits == 16 else data.take(count * 3, 8).reshape(count, 3).astype(np.uint8)


def _packed_records(palette: np.ndarray, color_bits: int) -> list[bytes]:
    records = []
    for colors in stored_colors(palette, color_bits).astype(np.int64):
        raw, delta = Writer().put(0, 8), Writer()
        put_colors(raw, colors, color_bits)
        base = colors.min(axis=0)
        widths = [int(v).bit_length() for v in colors.max(axis=0) - base]
        delta.put(0x80 | widths[0], 8).put(widths[1] << 4 | widths[2], 8).put(base, 8)
        mixed = np.concatenate([((colors[:, [c]] - base[c]) >> np.arange(w - 1, -1, -1)) & 1 for c, w in enumerate(widths)], axis=1)
        delta.put(mixed.ravel(), 1)
        raw, delta = raw.bytes(), delta.bytes()
        records.append(delta if len(delta) < len(raw) else raw)
    return records


def _unpack_record(data: bytes, at: int, shared: int, color_bits: int) -> np.ndarray:
    read = Reader(data, at * 8)
    tag = read.one(8)
    if tag == 0:
        return take_colors(read, shared, color_bits)
    other = read.one(8)
    widths = [tag & 127, other >> 4, other & 15]
    if tag < 128 or max(widths) > 8:
        raise ValueError("bad palette record")
    base = read.take(3, 8)
    bits = read.take(shared * sum(widths), 1).reshape(shared, sum(widths))
    out, start = [], 0
    for c, w in enumerate(widths):
        out.append(base[c] + bits[:, start : start + w] @ (1 << np.arange(w - 1, -1, -1)))
        start += w
    colors = np.stack(out, axis=1)
    if colors.max() > 255:
        raise ValueError("bad palette record")
    return colors.astype(np.uint8)


def encode(image: PaletteImage) -> bytes:
    """The file; its palettes are packed if that is smaller."""
    image.check()
    if image.vectors:
        raise ValueError("vector palettes are read only")
    plain = image.palettes * image.shared * image.color_bits // 8
    records = [] if image.scalar else _packed_records(image.palette, image.color_bits)
    size = 4 + 4 * image.palettes + sum(map(len, records))
    packed = bool(records) and size < plain
    head = Writer()
    for value, width in (
        (VERSION, 4), (image.width - 1, 24), (image.height - 1, 24), (log2(image.block) - 1, 3), (log2(image.local) - 1, 2), (log2(image.shared) - 1, 4),
        (image.color_bits == 24, 1), (0, 1), (0, 9), (0, 1), (log2(image.palettes), 3), (1 if image.scalar else 0, 2), (PACKED if packed else 0, 2),
    ):
        head.put(int(value), width)
    out = Writer()
    if packed:
        offsets = np.cumsum([0, *map(len, records)])[:-1]
        out.put([size, *offsets], 32).put(list(b"".join(records)), 8)
    elif image.scalar:
        out.put(image.palette[..., 0].ravel(), 8)
    else:
        put_colors(out, image.palette.reshape(-1, 3), image.color_bits)
    out.put(image.selectors, log2(image.palettes))
    out.put(image.table.ravel(), log2(image.shared))
    if not image.direct:
        out.put(image.indices.ravel(), log2(image.local))
    return MAGIC + head.bytes() + out.bytes()


@dataclass
class Header:
    width: int
    height: int
    block: int
    local: int
    shared: int
    palettes: int
    color_bits: int
    vectors: int
    vector_lab: bool
    scalar: bool
    packed: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.block)

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.block)


def read_header(data: bytes) -> Header:
    if data[:4] != MAGIC or len(data) < HEADER:
        raise ValueError("not a palette image")
    read = Reader(data[:HEADER], 32)
    names = [read.one(w) for w in (4, 24, 24, 3, 2, 4, 1, 1, 9, 1, 3, 2, 2)]
    version, width, height, block, local, shared, deep, vector, vectors, lab, palettes, channel, flags = names
    if version != VERSION:
        raise ValueError("unsupported version")
    if channel > 1 or flags & ~PACKED or (flags and (vector or channel)) or (vector and (palettes or channel)):
        raise ValueError("unsupported mode")
    head = Header(width + 1, height + 1, 2 << block, 2 << local, 2 << shared, 1 << palettes, 24 if deep else 16, vectors + 1 if vector else 0, bool(lab), channel == 1, bool(flags))
    if head.shared > LIMITS["shared"][1] or head.local > head.shared or head.local > head.block**2 or head.vectors > head.shared:
        raise ValueError("counts out of range")
    return head


def _palette_bits(data: bytes, head: Header) -> int:
    if head.packed:
        return int.from_bytes(data[HEADER : HEADER + 4], "big") * 8
    if head.vectors:
        return head.vectors * 2 * head.color_bits
    return head.palettes * head.shared * (8 if head.scalar else head.color_bits)


def to_lab(rgb: np.ndarray) -> np.ndarray:
    x = rgb / 255.0
    linear = np.where(x <= SRGB_BREAK, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    return np.cbrt(linear @ np.array(TO_LMS).T) @ np.array(TO_LAB).T


def from_lab(lab: np.ndarray) -> np.ndarray:
    linear = np.clip((lab @ np.array(FROM_LAB).T) ** 3 @ np.array(FROM_LMS).T, 0, 1)
    return np.where(linear <= LINEAR_BREAK, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055) * 255


def vector_palette(ends: np.ndarray, shared: int, lab: bool) -> np.ndarray:
    """A palette of ramps between pairs of colours (vectors, 2, 3), of nearly equal length."""
    ramps = []
    for k, pair in enumerate(ends.astype(np.float64)):
        n = shared // len(ends) + (1 if k < shared % len(ends) else 0)
        a, b = to_lab(pair) if lab else pair
        steps = a + (b - a) * (np.arange(n) / max(1, n - 1))[:, None]
        ramps.append(from_lab(steps) if lab else steps)
    return np.clip(np.floor(np.concatenate(ramps) + 0.5), 0, 255).astype(np.uint8)


def decode(data: bytes) -> PaletteImage:
    head = read_header(data)
    start = HEADER * 8 + _palette_bits(data, head)
    direct = head.local == head.block**2
    total = start + head.blocks * (log2(head.palettes) + head.local * log2(head.shared)) + (0 if direct else head.width * head.height * log2(head.local))
    if len(data) != -(-total // 8):
        raise ValueError("the size of the file does not match its header")
    read, ends = Reader(data, HEADER * 8), np.zeros((0, 2, 3))
    if head.packed:
        first = HEADER + 4 + 4 * head.palettes
        offsets = Reader(data, HEADER * 8 + 32).take(head.palettes, 32)
        palette = np.stack([_unpack_record(data, first + int(o), head.shared, head.color_bits) for o in offsets])
    elif head.vectors:
        ends = take_colors(read, head.vectors * 2, head.color_bits).reshape(-1, 2, 3)
        palette = vector_palette(ends, head.shared, head.vector_lab)[None]
    elif head.scalar:
        palette = np.repeat(read.take(head.palettes * head.shared, 8).astype(np.uint8)[:, None], 3, axis=1).reshape(head.palettes, head.shared, 3)
    else:
        palette = take_colors(read, head.palettes * head.shared, head.color_bits).reshape(head.palettes, head.shared, 3)
    read.at = start
    selectors = read.take(head.blocks, log2(head.palettes))
    table = read.take(head.blocks * head.local, log2(head.shared)).reshape(head.blocks, head.local)
    indices = None if direct else read.take(head.width * head.height, log2(head.local)).reshape(head.height, head.width)
    return PaletteImage(head.width, head.height, head.block, palette, selectors, table, indices, head.color_bits, head.scalar, list(ends))


def sample(data: bytes, x: int, y: int) -> tuple[int, int, int]:
    """The colour of one pixel, from its own fields."""
    head = read_header(data)
    if not (0 <= x < head.width and 0 <= y < head.height):
        raise ValueError("pixel out of range")
    if head.vectors:
        return tuple(map(int, decode(data).pixels()[y, x]))
    pal_bits, idx_bits, slot_bits = log2(head.palettes), log2(head.shared), log2(head.local)
    selectors = HEADER * 8 + _palette_bits(data, head)
    tables = selectors + head.blocks * pal_bits
    block = y // head.block * head.across + x // head.block
    if head.local == head.block**2:
        slot = y % head.block * head.block + x % head.block
    else:
        slot = field_at(data, tables + head.blocks * head.local * idx_bits + (y * head.width + x) * slot_bits, slot_bits)
    pal = field_at(data, selectors + block * pal_bits, pal_bits)
    idx = field_at(data, tables + (block * head.local + slot) * idx_bits, idx_bits)
    if head.packed:
        first = HEADER + 4 + 4 * head.palettes
        record = first + int.from_bytes(data[HEADER + 4 + 4 * pal : HEADER + 8 + 4 * pal], "big")
        return tuple(map(int, _unpack_record(data, record, head.shared, head.color_bits)[idx]))
    if head.scalar:
        return (data[HEADER + pal * head.shared + idx],) * 3
    at = HEADER * 8 + (pal * head.shared + idx) * head.color_bits
    code = field_at(data, at, head.color_bits)
    return tuple(map(int, from_565(np.array(code)))) if head.color_bits == 16 else (code >> 16, code >> 8 & 255, code & 255)
