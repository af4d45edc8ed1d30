"""Palette images whose blocks of slots refer to a dictionary of patterns.

Blocks are first brought to a canonical order of slots. Each block is then
stored in the form that takes the fewest bits: as it is, as runs, as a pattern
with places that differ, as a turned or mirrored pattern with such places, or as
a pattern with a bitmap of them. A checkpoint every few blocks keeps any block
within a short scan.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessella.operators.matching import DIHEDRAL
from tessella.sources import adaptive_file, palette_file
from tessella.sources.bits import Reader, Writer, field_at, log2
from tessella.sources.palette_file import PaletteImage, from_565, put_colors, take_colors

# Magic, version, mode numbers and header layout.
MAGIC, VERSION = b"BPDI", 3
NEAR, RAW, RUNS, TURNED = 0, 1, 2, 3
HEAD = struct.Struct("<4sBBBBBBBBIIHHI")
DICTIONARY, SAMPLE, CHECKPOINT = 64, 8192, 4


def turned_places(size: int, transform: int) -> np.ndarray:
    """Where in a pattern each place of a block looks under one of the eight symmetries."""
    y, x = np.divmod(np.arange(size * size), size)
    swap, mirror_x, mirror_y = DIHEDRAL[transform]
    u, v = (y, x) if swap else (x, y)
    return (size - 1 - v if mirror_y else v) * size + (size - 1 - u if mirror_x else u)


def canonical(image: PaletteImage) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, table): slots of every block, padded with 0, and block tables in their new order.

    Used slots come first, by first use; the rest by brightness, colour and index.
    """
    size, n = image.block, image.block**2
    down = image.blocks // image.across
    full = np.full((down * size, image.across * size), -1, dtype=np.int64)
    full[: image.height, : image.width] = image.indices
    slots = full.reshape(down, size, image.across, size).swapaxes(1, 2).reshape(image.blocks, n)
    first = np.stack([np.where((slots == k).any(axis=1), (slots == k).argmax(axis=1), n) for k in range(image.local)], axis=1)
    colors = image.palette[image.selectors[:, None], image.table].astype(np.int64)
    luma = colors @ [2126, 7152, 722]
    old = np.broadcast_to(np.arange(image.local), first.shape)
    order = np.lexsort((old, image.table, colors[..., 2], colors[..., 1], colors[..., 0], luma, first, first == n), axis=1)
    new = np.argsort(order, axis=1)
    patterns = np.where(slots < 0, 0, np.take_along_axis(new, np.maximum(slots, 0), axis=1))
    return patterns, np.take_along_axis(image.table, order, axis=1)


def prototypes(patterns: np.ndarray, most: int = DICTIONARY, sample: int = SAMPLE) -> np.ndarray:
    """Patterns for the dictionary: the most frequent, then each time the one with the largest
    distance from those chosen, times 1 + log2(count + 1); the first on ties."""
    blocks = len(patterns)
    count = min(blocks, sample)
    rows = patterns[np.arange(count) * blocks // count]
    distinct, at, counts = np.unique(rows, axis=0, return_index=True, return_counts=True)
    order = np.argsort(at)
    distinct, counts = distinct[order], counts[order]
    chosen, near = [], np.full(len(distinct), patterns.shape[1] + 1)
    pick = int(counts.argmax())
    while len(chosen) < min(most, len(distinct)):
        chosen.append(pick)
        near = np.minimum(near, (distinct != distinct[pick]).sum(axis=1))
        score = near * (1 + np.log2(counts + 1))
        pick = int(score.argmax())
        if score[pick] <= 0:
            break
    return distinct[chosen]


@dataclass
class Plan:
    """How each block is stored with one size of dictionary, and the bits that this takes."""

    dictionary: np.ndarray
    mode: np.ndarray
    proto: np.ndarray
    transform: np.ndarray
    count: np.ndarray
    bits: np.ndarray
    section: int


def plans(patterns: np.ndarray, protos: np.ndarray, size: int, slot_bits: int, interval: int) -> list[Plan]:
    """A plan for every power of two up to the number of prototypes."""
    n, edit = size * size, 2 * log2(size) + slot_bits
    changes = (patterns[:, 1:] != patterns[:, :-1]).sum(axis=1)
    places = [turned_places(size, t) for t in range(8)]
    distance = np.stack([np.stack([(patterns != p[at]).sum(axis=1) for at in places], axis=1) for p in protos], axis=1)  # (blocks, prototypes, transforms)
    out, k = [], 1
    while k <= len(protos):
        plain = distance[:, :k, 0]
        near_at, near = plain.argmin(axis=1), plain.min(axis=1)
        turned = distance[:, :k, 1:].reshape(len(patterns), -1)
        turned_at, turned_d = turned.argmin(axis=1), turned.min(axis=1)
        # in order of precedence: a later form replaces an earlier one only if it takes fewer bits
        forms = np.stack([np.full(len(patterns), n * slot_bits), slot_bits + changes * edit, near * edit, 3 + n + near * slot_bits, 3 + turned_d * edit], axis=1)
        form = forms.argmin(axis=1)
        mode = np.array([RAW, RUNS, NEAR, TURNED, TURNED])[form]
        count = np.choose(form, [0 * near, changes, near, near, turned_d])
        proto = np.where(form == 4, turned_at // 7, near_at)
        transform = np.where(form == 4, turned_at % 7 + 1, 0)
        bits = forms.min(axis=1)
        tags = len(patterns) * (2 + log2(k) + int(n).bit_length())
        groups = -(-len(patterns) // interval)
        out.append(Plan(protos[:k], mode, proto, transform, count, bits, k * n * slot_bits + tags + (groups + 1) * 32 + int(bits.sum())))
        k *= 2
    return out


def best_plan(patterns: np.ndarray, image: PaletteImage, most: int = DICTIONARY, sample: int = SAMPLE, interval: int = 1 << CHECKPOINT) -> Plan | None:
    """The plan with the fewest bits, the smaller dictionary on ties; None if plain slots take no more."""
    best, least = None, image.width * image.height * log2(image.local)
    for plan in plans(patterns, prototypes(patterns, most, sample), image.block, log2(image.local), interval):
        if plan.section < least:
            best, least = plan, plan.section
    return best


def encode(image: PaletteImage, most: int = DICTIONARY, sample: int = SAMPLE, checkpoint: int = CHECKPOINT) -> bytes:
    image.check()
    slot_bits, n = log2(image.local), image.block**2
    patterns, table = (None, image.table) if image.direct else canonical(image)
    plan = None if image.direct else best_plan(patterns, image, most, sample, 1 << checkpoint)
    payload = 0 if image.direct else int(plan.bits.sum()) if plan else image.width * image.height * slot_bits
    out = Writer()
    put_colors(out, image.palette.reshape(-1, 3), image.color_bits)
    out.put(image.selectors, log2(image.palettes)).put(table.ravel(), log2(image.shared))
    if plan:
        out.put(plan.dictionary.ravel(), slot_bits)
        uses = (plan.mode == NEAR) | (plan.mode == TURNED)
        for mode, proto, count in zip(plan.mode, np.where(uses, plan.proto, 0), np.where(plan.mode == RAW, 0, plan.count), strict=True):
            out.put(mode, 2).put(proto, log2(len(plan.dictionary))).put(count, int(n).bit_length())
        ends = np.concatenate([[0], np.cumsum(plan.bits)])
        out.put(np.append(ends[:-1][:: 1 << checkpoint], ends[-1]), 32)
        for b, p in enumerate(patterns):
            _put_block(out, p, plan, b, image.block, slot_bits)
    elif not image.direct:
        at = image.block_of()
        place = np.arange(image.height)[:, None] % image.block * image.block + np.arange(image.width)[None, :] % image.block
        out.put(patterns[at, place].ravel(), slot_bits)
    head = HEAD.pack(MAGIC, VERSION, int(image.direct), log2(image.block), slot_bits, log2(image.shared), log2(image.palettes), image.color_bits, checkpoint, image.width, image.height, len(plan.dictionary) if plan else 0, 0, payload)
    return head + out.bytes()


def _put_block(out: Writer, p: np.ndarray, plan: Plan, b: int, size: int, slot_bits: int) -> None:
    mode, place_bits = plan.mode[b], 2 * log2(size)
    if mode == RAW:
        out.put(p, slot_bits)
        return
    if mode == RUNS:
        out.put(p[0], slot_bits)
        at = np.nonzero(p[1:] != p[:-1])[0] + 1
    else:
        t = plan.transform[b]
        wrong = p != plan.dictionary[plan.proto[b]][turned_places(size, t)]
        if mode == TURNED:
            out.put(t, 3)
        at = np.nonzero(wrong)[0]
        if mode == TURNED and t == 0:
            out.put(wrong.astype(int), 1).put(p[at], slot_bits)
            return
    for i in at:
        out.put(i, place_bits).put(p[i], slot_bits)


class Patterned:
    """An opened file; colours are read by coordinate, a block's bits by its checkpoint."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size or data[:4] != MAGIC:
            raise ValueError("not a pattern image")
        _, version, direct, block, self.slot_bits, self.idx_bits, self.pal_bits, self.color_bits, self.checkpoint, self.width, self.height, self.size, reserved, payload = HEAD.unpack_from(data)
        if version != VERSION or direct > 1 or reserved or self.color_bits not in (16, 24) or self.checkpoint > 12 or not (self.width and self.height):
            raise ValueError("unsupported header")
        self.data, self.block, self.direct, n = data, 1 << block, bool(direct), 1 << 2 * block
        self.across = -(-self.width // self.block)
        self.blocks = self.across * -(-self.height // self.block)
        self.count_bits = n.bit_length()
        at = HEAD.size * 8
        self.selectors_at = at + (1 << self.pal_bits + self.idx_bits) * self.color_bits
        self.table_at = self.selectors_at + self.blocks * self.pal_bits
        at = self.table_at + self.blocks * (1 << self.slot_bits) * self.idx_bits
        if self.size:
            self.proto_bits = log2(self.size)
            self.tags_at = at + self.size * n * self.slot_bits
            self.directory_at = self.tags_at + self.blocks * (2 + self.proto_bits + self.count_bits)
            read = Reader(data, at)
            self.dictionary = read.take(self.size * n, self.slot_bits).reshape(self.size, n)
            at = self.directory_at + 32 * (-(-self.blocks // (1 << self.checkpoint)) + 1)
        self.payload_at = at
        if len(data) != -(-(at + payload) // 8):
            raise ValueError("the size of the file does not match its header")

    def _tag(self, b: int) -> tuple[int, int, int]:
        at = self.tags_at + b * (2 + self.proto_bits + self.count_bits)
        f = lambda skip, w: field_at(self.data, at + skip, w)
        return f(0, 2), f(2, self.proto_bits), f(2 + self.proto_bits, self.count_bits)

    def _length(self, mode: int, count: int, at: int) -> int:
        n, edit = self.block**2, 2 * log2(self.block) + self.slot_bits
        if mode == RAW:
            return n * self.slot_bits
        if mode == RUNS:
            return self.slot_bits + count * edit
        if mode == NEAR:
            return count * edit
        return 3 + (n + count * self.slot_bits if field_at(self.data, at, 3) == 0 else count * edit)

    def slots(self, b: int) -> np.ndarray:
        """The canonical slots of one block."""
        group = b >> self.checkpoint
        at = self.payload_at + field_at(self.data, self.directory_at + 32 * group, 32)
        for k in range(group << self.checkpoint, b):
            mode, _, count = self._tag(k)
            at += self._length(mode, count, at)
        mode, proto, count = self._tag(b)
        read, n, place_bits = Reader(self.data, at), self.block**2, 2 * log2(self.block)
        if mode == RAW:
            return read.take(n, self.slot_bits)
        if mode == RUNS:
            first = read.one(self.slot_bits)
            edits = read.take(count * (place_bits + self.slot_bits), 1).reshape(count, -1)
            out, places = np.full(n, first), edits[:, :place_bits] @ (1 << np.arange(place_bits - 1, -1, -1))
            for p, v in zip(places, edits[:, place_bits:] @ (1 << np.arange(self.slot_bits - 1, -1, -1)), strict=True):
                out[p:] = v
            return out
        t = read.one(3) if mode == TURNED else 0
        out = self.dictionary[proto][turned_places(self.block, t)].copy()
        if mode == TURNED and t == 0:
            wrong = np.nonzero(read.take(n, 1))[0]
            if len(wrong) != count:
                raise ValueError("bad bitmap")
            out[wrong] = read.take(count, self.slot_bits)
            return out
        for _ in range(count):
            p = read.one(place_bits)
            out[p] = read.one(self.slot_bits)
        return out

    def _slot(self, b: int, x: int, y: int) -> int:
        place = y % self.block * self.block + x % self.block
        if self.direct:
            return place
        if self.size:
            return int(self.slots(b)[place])
        return field_at(self.data, self.payload_at + (y * self.width + x) * self.slot_bits, self.slot_bits)

    def sample(self, x: int, y: int) -> tuple[int, int, int]:
        if not (0 <= x < self.width and 0 <= y < self.height):
            raise ValueError("pixel out of range")
        b = y // self.block * self.across + x // self.block
        slot = self._slot(b, x, y)
        pal = field_at(self.data, self.selectors_at + b * self.pal_bits, self.pal_bits)
        idx = field_at(self.data, self.table_at + (b * (1 << self.slot_bits) + slot) * self.idx_bits, self.idx_bits)
        code = field_at(self.data, HEAD.size * 8 + ((pal << self.idx_bits) + idx) * self.color_bits, self.color_bits)
        return tuple(map(int, from_565(np.array(code)))) if self.color_bits == 16 else (code >> 16, code >> 8 & 255, code & 255)

    def image(self) -> PaletteImage:
        """The whole image, with canonical slots."""
        read = Reader(self.data, HEAD.size * 8)
        palette = take_colors(read, 1 << self.pal_bits + self.idx_bits, self.color_bits).reshape(1 << self.pal_bits, -1, 3)
        selectors = read.take(self.blocks, self.pal_bits)
        table = read.take(self.blocks << self.slot_bits, self.idx_bits).reshape(self.blocks, -1)
        out = PaletteImage(self.width, self.height, self.block, palette, selectors, table, None, self.color_bits)
        if self.direct:
            return out
        if not self.size:
            out.indices = read.take(self.width * self.height, self.slot_bits).reshape(self.height, self.width)
            return out
        patterns = np.stack([self.slots(b) for b in range(self.blocks)])
        place = np.arange(self.height)[:, None] % self.block * self.block + np.arange(self.width)[None, :] % self.block
        out.indices = patterns[out.block_of(), place]
        return out


def encode_smallest(image: PaletteImage, **options) -> bytes:
    """The pattern file if it is smaller than the plain palette file, else that."""
    plain, patterned = palette_file.encode(image), encode(image, **options)
    return patterned if len(patterned) < len(plain) else plain


def sampler(data: bytes):
    """A function of (x, y) for a file of any palette kind, told by its magic."""
    if data[:4] == MAGIC:
        return Patterned(data).sample
    if data[:4] == adaptive_file.MAGIC:
        return adaptive_file.Adaptive(data).sample
    palette_file.read_header(data)
    return lambda x, y: palette_file.sample(data, x, y)
