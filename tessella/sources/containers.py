"""Plain image files and texture containers."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np


def read_ppm(data: bytes) -> np.ndarray:
    """(height, width, 3) of a binary PPM with a maximum of 255; comments are allowed between the numbers."""
    token = rb"(?:\s+|#[^\n]*\n)+"
    m = re.match(rb"P6" + token + rb"(\d+)" + token + rb"(\d+)" + token + rb"(\d+)\s", data)
    if not m:
        raise ValueError("not a binary PPM")
    width, height, top = map(int, m.groups())
    if top != 255 or not (width and height) or len(data) - m.end() < width * height * 3:
        raise ValueError("unsupported or truncated PPM")
    return np.frombuffer(data, dtype=np.uint8, count=width * height * 3, offset=m.end()).reshape(height, width, 3)


def write_ppm(rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + np.ascontiguousarray(rgb, dtype=np.uint8).tobytes()


def read_rgba(data: bytes, width: int, height: int) -> np.ndarray:
    """(height, width, 4) of a headerless file."""
    if width < 1 or height < 1 or len(data) != width * height * 4:
        raise ValueError("the size of the file does not match the dimensions")
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)


def write_rgba(rgba: np.ndarray) -> bytes:
    return np.ascontiguousarray(rgba, dtype=np.uint8).tobytes()


def scaled_16(v: np.ndarray) -> np.ndarray:
    """16-bit samples as bytes, rounded."""
    return ((v.astype(np.int64) + 128) // 257).astype(np.uint8)


# Flags of the texture containers.
_CAPS, _FOUR_CC, _TEXTURE = 0x00081007, 4, 0x1000
_BC7_FORMAT, _TEXTURE_2D = 98, 3


def write_dds(kind: str, payload: bytes, width: int, height: int) -> bytes:
    """A DDS file of BC1 or BC7 blocks."""
    per_block = {"bc1": 8, "bc7": 16}[kind]
    if len(payload) != -(-width // 4) * -(-height // 4) * per_block:
        raise ValueError("wrong payload size")
    pixel_format = struct.pack("<II4s5I", 32, _FOUR_CC, b"DXT1" if kind == "bc1" else b"DX10", 0, 0, 0, 0, 0)
    head = b"DDS " + struct.pack("<7I", 124, _CAPS, height, width, len(payload), 0, 1) + bytes(44) + pixel_format + struct.pack("<5I", _TEXTURE, 0, 0, 0, 0)
    tail = struct.pack("<5I", _BC7_FORMAT, _TEXTURE_2D, 0, 1, 0) if kind == "bc7" else b""
    return head + tail + payload


def write_astc(payload: bytes, width: int, height: int, block: tuple[int, int]) -> bytes:
    """An ASTC file of blocks that another encoder has made."""
    if len(payload) != -(-width // block[0]) * -(-height // block[1]) * 16:
        raise ValueError("wrong payload size")
    extent = b"".join(n.to_bytes(3, "little") for n in (width, height, 1))
    return struct.pack("<I", 0x5CA1AB13) + bytes([*block, 1]) + extent + payload


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of a PNG without interlacing; 16-bit samples are scaled, and transparency is refused."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, head, table, packed = 8, None, None, []
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("broken PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            table = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            raise ValueError("transparent pixels are not supported")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[4] or head[5] or (head[3] == 3 and table is None):
        raise ValueError("unsupported PNG")
    width, height, depth, kind, *_, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or interlaced or depth not in ((1, 2, 4, 8) if kind == 3 else (1, 2, 4, 8, 16) if kind == 0 else (8, 16)):
        raise ValueError("unsupported PNG")
    step, row = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)
    if len(raw) != height * (row + 1):
        raise ValueError("broken PNG")
    raw = raw.reshape(height, row + 1)
    out = np.zeros((height + 1, row + step), dtype=np.int64)
    for y in range(height):
        _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), out[y + 1], out[y], step)
    lines = out[1:, step:].astype(np.uint8)
    if depth == 16:
        values = scaled_16(lines.reshape(height, width * channels, 2).astype(np.int64) @ np.array([256, 1]))
    elif depth == 8:
        values = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)[:, : width * channels]
        values = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
        values = values if kind == 3 else (values.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    values = values.reshape(height, width, channels)
    if kind == 3:
        if values.max(initial=0) >= len(table):
            raise ValueError("broken PNG")
        return table[values[..., 0]]
    if channels in (2, 4) and (values[..., -1] != 255).any():
        raise ValueError("transparent pixels are not supported")
    return np.repeat(values[..., :1], 3, axis=2) if channels < 3 else values[..., :3]


def _unfilter(kind: int, x: np.ndarray, now: np.ndarray, above: np.ndarray, step: int) -> None:
    """Undoes the filter of one line; ``now`` and ``above`` have ``step`` zeros before them."""
    up = above[step:]
    if kind in (0, 2):
        now[step:] = (x + (up if kind == 2 else 0)) & 255
    elif kind == 1:
        for k in range(step):
            now[step + k :: step] = np.cumsum(x[k::step]) & 255
    elif kind in (3, 4):
        for i in range(len(x)):
            a, b, c = now[i], above[i + step], above[i]
            if kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now[i + step] = (x[i] + guess) & 255
    else:
        raise ValueError("broken PNG")
