"""Coefficients of JPEG files, baseline and progressive, without reconstructing samples.

Follows ITU-T T.81: 8-bit samples, one or three components, Huffman coding,
restart intervals, interleaved and single-component scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessella.functions.coding import zigzag

ORDER = (0, *zigzag(8, 8))


@dataclass
class Component:
    id: int
    across: int  # sampling factors
    down: int
    table: int
    columns: int = 0  # blocks, padded to whole units
    rows: int = 0
    own_columns: int = 0  # blocks that cover the component's own samples
    own_rows: int = 0
    blocks: np.ndarray | None = None  # (rows, columns, 64) coefficients in natural order


@dataclass
class Jpeg:
    width: int
    height: int
    components: list[Component]
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)

    def dequantised(self, k: int) -> np.ndarray:
        """(rows, columns, 64) coefficients times their table."""
        c = self.components[k]
        return c.blocks * self.quantisation[c.table]


class _Bits:
    """Bits of entropy-coded data, cut at restart markers."""

    def __init__(self, data: bytes):
        parts, at = [], 0
        while True:
            cut = data.find(b"\xff", at)
            while cut >= 0 and data[cut + 1 : cut + 2] == b"\x00":
                cut = data.find(b"\xff", cut + 2)
            parts.append(data[at : cut if cut >= 0 else len(data)].replace(b"\xff\x00", b"\xff"))
            if cut < 0:
                break
            at = cut + 2
        self.parts, self.index = parts, -1
        self.restart()

    def restart(self) -> None:
        self.index += 1
        part = self.parts[self.index] if self.index < len(self.parts) else b""
        self.bits, self.at = np.unpackbits(np.frombuffer(part, dtype=np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value << 1 | bit
        short = self.at + n - len(self.bits)
        if short > 64:
            raise ValueError("truncated scan")
        self.at += n
        return value << max(0, min(short, n))

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def _huffman(data: bytes, at: int) -> tuple[dict[tuple[int, int], int], int]:
    counts, table, code = data[at : at + 16], {}, 0
    at += 16
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = data[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table, at


def parse(data: bytes) -> Jpeg:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, progressive, restart = 2, None, False, 0
    tables: dict[tuple[int, int], dict] = {}
    quantisation: dict[int, np.ndarray] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, end = at + 4, at + 2 + size
        if marker in (0xC0, 0xC1, 0xC2):
            image, progressive = _frame(data[body:end]), marker == 0xC2
            image.quantisation = quantisation
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("unsupported kind of JPEG")
        elif marker == 0xC4:
            while body < end:
                info = data[body]
                tables[info >> 4, info & 15], body = _huffman(data, body + 1)
        elif marker == 0xDB:
            while body < end:
                if data[body] >> 4:
                    raise ValueError("only 8-bit quantisation tables are supported")
                table = np.zeros(64, dtype=np.int64)
                table[list(ORDER)] = list(data[body + 1 : body + 65])
                quantisation[data[body] & 15], body = table, body + 65
        elif marker == 0xDD:
            restart = int.from_bytes(data[body : body + 2], "big")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            stop = end
            while stop + 1 < len(data) and not (data[stop] == 0xFF and data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7):
                stop = data.find(b"\xff", stop + 1)
                if stop < 0:
                    stop = len(data)
            _scan(image, data[body:end], _Bits(data[end:stop]), tables, restart, progressive)
            end = stop
        at = end
    if image is None or any(c.table not in quantisation for c in image.components):
        raise ValueError("no image in the file")
    return image


def _frame(body: bytes) -> Jpeg:
    if body[0] != 8:
        raise ValueError("only 8-bit samples are supported")
    height, width, count = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
    if not (width and height) or count not in (1, 3):
        raise ValueError("unsupported frame")
    components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
    wide, tall = max(c.across for c in components), max(c.down for c in components)
    for c in components:
        c.columns, c.rows = -(-width // (8 * wide)) * c.across, -(-height // (8 * tall)) * c.down
        c.own_columns, c.own_rows = -(-(-(-width * c.across // wide)) // 8), -(-(-(-height * c.down // tall)) // 8)
        c.blocks = np.zeros((c.rows, c.columns, 64), dtype=np.int64)
    return Jpeg(width, height, components)


def _scan(image: Jpeg, head: bytes, bits: _Bits, tables: dict, restart: int, progressive: bool) -> None:
    count = head[0]
    chosen = [(next((c for c in image.components if c.id == head[1 + 2 * k]), None), head[2 + 2 * k]) for k in range(count)]
    first, last, high, low = head[1 + 2 * count], head[2 + 2 * count], head[3 + 2 * count] >> 4, head[3 + 2 * count] & 15
    if any(c is None for c, _ in chosen) or not first <= last <= 63 or (progressive and (first == 0) != (last == 0)) or (progressive and first and count > 1) or (not progressive and (first, last, high, low) != (0, 63, 0, 0)):
        raise ValueError("bad scan")
    before, run = dict.fromkeys((c.id for c, _ in chosen), 0), [0]
    if count == 1:
        c = chosen[0][0]
        units = [[(c, y, x)] for y in range(c.own_rows) for x in range(c.own_columns)]
    else:
        c = chosen[0][0]
        units = [
            [(c, y * c.down + j, x * c.across + i) for c, _ in chosen for j in range(c.down) for i in range(c.across)]
            for y in range(c.rows // c.down) for x in range(c.columns // c.across)
        ]
    names = {c.id: t for c, t in chosen}
    for n, unit in enumerate(units):
        if restart and n and n % restart == 0:
            bits.restart()
            before, run = dict.fromkeys(before, 0), [0]
        for c, y, x in unit:
            block, t = c.blocks[y, x], names[c.id]
            if first == 0 and not high:
                before[c.id] += bits.signed(bits.symbol(tables[0, t >> 4]))
                block[0] = before[c.id] << low
            elif first == 0:
                block[0] |= bits.take(1) << low
            if last and not high:
                _first_pass(block, bits, tables[1, t & 15], max(1, first), last, low, run)
            elif last:
                _refine(block, bits, tables[1, t & 15], first, last, 1 << low, run)


def _first_pass(block: np.ndarray, bits: _Bits, table: dict, first: int, last: int, low: int, run: list[int]) -> None:
    if run[0]:
        run[0] -= 1
        return
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            if k > last:
                raise ValueError("bad run")
            block[ORDER[k]] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            run[0] = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
            return


def _refine(block: np.ndarray, bits: _Bits, table: dict, first: int, last: int, one: int, run: list[int]) -> None:
    def touch(p: int) -> None:
        if bits.take(1) and not abs(int(block[p])) & one:
            block[p] += one if block[p] > 0 else -one

    k = first
    while not run[0] and k <= last:
        symbol = bits.symbol(table)
        zeros, size, value = symbol >> 4, symbol & 15, 0
        if size:
            value = one if bits.take(1) else -one
        elif zeros < 15:
            run[0] = (1 << zeros) + (bits.take(zeros) if zeros else 0)
            break
        while k <= last:
            p = ORDER[k]
            k += 1
            if block[p]:
                touch(p)
            elif zeros:
                zeros -= 1
            else:
                block[p] = value
                break
    if run[0]:
        for p in ORDER[k : last + 1]:
            if block[p]:
                touch(p)
        run[0] -= 1


def samples(image: Jpeg, k: int) -> np.ndarray:
    """Samples of a component at its own size, 0 to 255, not rounded."""
    from tessella.operators.transform import inverse_float

    f = image.dequantised(k)
    c = image.components[k]
    planes = inverse_float(f.reshape(-1, 8, 8)) + 128
    wide, tall = max(x.across for x in image.components), max(x.down for x in image.components)
    full = planes.reshape(c.rows, c.columns, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.columns * 8)
    return full[: -(-image.height * c.down // tall), : -(-image.width * c.across // wide)]


def resampled(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A component at the image's size, bilinear about sample centres."""
    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        a = np.floor(at).astype(int)
        return a, np.minimum(a + 1, m - 1), at - a

    a, b, w = axis(height, plane.shape[0])
    rows = plane[a] * (1 - w)[:, None] + plane[b] * w[:, None]
    a, b, w = axis(width, plane.shape[1])
    return rows[:, a] * (1 - w) + rows[:, b] * w


def pixels(image: Jpeg) -> np.ndarray:
    """(height, width, 3) bytes."""
    planes = [resampled(samples(image, k), image.height, image.width) for k in range(len(image.components))]
    y = planes[0]
    u, v = (planes[1] - 128, planes[2] - 128) if len(planes) == 3 else (0.0, 0.0)
    rgb = np.stack(np.broadcast_arrays(y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u), axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


def transcode(image: Jpeg, preset: str = "3", quality: int = 75) -> bytes:
    """A transform image made from the coefficients, without going through colours.

    Where the sampling is 4:2:0 or grey and luma blocks are 8 by 8, each unit's
    blocks are the file's own. Otherwise samples of each component are brought
    to the size of the unit's planes and transformed.
    """
    import struct
    from dataclasses import replace

    from tessella.operators.transform import forward_float
    from tessella.sources import dct_file
    from tessella.sources.dct_records import CODINGS, choose, write

    layout = dct_file.layout_for(image.width, image.height, preset)
    kind = replace(CODINGS[dct_file.DEFAULT_CODING[preset]], zigzag=True)
    down, across = layout.units // layout.across, layout.across
    factors = [(c.across, c.down) for c in image.components]
    f = [np.zeros((layout.units, h, w)) for _, w, h, _, _ in layout.records()]
    direct = layout.split and (len(factors) == 1 or factors == [(2, 2), (1, 1), (1, 1)])

    def padded(p: np.ndarray, rows: int, columns: int) -> np.ndarray:
        return p[np.minimum(np.arange(rows), p.shape[0] - 1)][:, np.minimum(np.arange(columns), p.shape[1] - 1)]

    if direct:
        blocks = [padded(image.dequantised(k).astype(np.float64), down * (1 if k else 2), across * (1 if k else 2)) for k in range(len(factors))]
        for k in range(4):
            f[k] = blocks[0][k // 2 :: 2, k % 2 :: 2].reshape(-1, 8, 8)
        for k in range(1, len(blocks)):
            f[3 + k] = blocks[k].reshape(-1, 8, 8)
    else:
        full = [resampled(samples(image, k), image.height, image.width) - 128 for k in range(len(factors))]
        tiles = [padded(p, down * 16, across * 16).reshape(down, 16, across, 16).swapaxes(1, 2).reshape(-1, 16, 16) for p in full]
        luma = [tiles[0][:, y : y + 8, x : x + 8] for y in (0, 8) for x in (0, 8)] if layout.split else [tiles[0]]
        chroma = [t.reshape(-1, 8, 2, 8, 2).mean(axis=(2, 4)) for t in tiles[1:]] or [np.zeros((layout.units, 8, 8))] * 2
        f = [forward_float(p) for p in [*luma, *chroma]]
    out = np.zeros((layout.units, layout.unit), dtype=np.uint8)
    for (component, w, h, at, n), v in zip(layout.records(), f, strict=True):
        for u in range(layout.units):
            out[u, at : at + n] = np.frombuffer(write(choose(v[u].ravel(), w, h, n, quality, component > 0, kind), n), dtype=np.uint8)
    flags = (dct_file.SPLIT if layout.split else 0) | dct_file.HALF | dct_file.ZIGZAG | kind.number << 8
    head = dct_file.MAGIC + struct.pack("<14I", dct_file.VERSION, layout.mode, layout.width, layout.height, across, down, layout.unit, *layout.sizes, quality, flags, layout.units * layout.unit, 0)
    return head + out.tobytes()
