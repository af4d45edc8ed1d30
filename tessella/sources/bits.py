"""Bit fields of binary files, whole arrays of them at a time."""

from __future__ import annotations

import numpy as np


class Writer:
    """Collects fields, most significant bit first."""

    def __init__(self) -> None:
        self._parts: list[np.ndarray] = []
        self.bits = 0

    def put(self, values, width: int) -> Writer:
        """One value or an array of them, each in ``width`` bits."""
        v = np.atleast_1d(np.asarray(values, dtype=np.int64))
        if v.size and (v.min() < 0 or v.max() >= 1 << width):
            raise ValueError(f"a value does not fit {width} bits")
        self._parts.append(((v[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel())
        self.bits += v.size * width
        return self

    def align(self) -> Writer:
        return self.put(0, -self.bits % 8) if self.bits % 8 else self

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self._parts)).tobytes() if self._parts else b""


class Reader:
    """Reads fields, most significant bit first; fails on reading past the end."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self._bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)), at

    def take(self, count: int, width: int) -> np.ndarray:
        end = self.at + count * width
        if end > len(self._bits):
            raise ValueError("truncated file")
        field = self._bits[self.at : end].reshape(count, width).astype(np.int64)
        self.at = end
        return field @ (np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else np.zeros(count, dtype=np.int64)

    def one(self, width: int) -> int:
        return int(self.take(1, width)[0])

    def align(self) -> None:
        self.at += -self.at % 8

    def golomb(self) -> int:
        """An unsigned Exp-Golomb number."""
        ahead = self._bits[self.at : self.at + 54]
        zeros = int(ahead.argmax()) if ahead.any() else len(ahead)
        if zeros > 52 or not ahead.any():
            raise ValueError("bad Exp-Golomb number")
        self.at += zeros
        return self.one(zeros + 1) - 1

    def signed_golomb(self) -> int:
        v = self.golomb()
        return (v + 1) // 2 if v % 2 else -(v // 2)


def put_golomb(out: Writer, v: int) -> None:
    n = (v + 1).bit_length() - 1
    out.put(0, n) if n else None
    out.put(v + 1, n + 1)


def put_signed_golomb(out: Writer, v: int) -> None:
    put_golomb(out, 2 * v - 1 if v > 0 else -2 * v)


def field_at(data: bytes, bit: int, width: int) -> int:
    """One field, reading no more than the bytes that hold it."""
    if not width:
        return 0
    last = bit + width
    chunk = int.from_bytes(data[bit // 8 : -(-last // 8)], "big")
    return (chunk >> (-last % 8)) & ((1 << width) - 1)


def low_field_at(data: bytes, bit: int, width: int) -> int:
    """One field, least significant bit first."""
    chunk = int.from_bytes(data[bit // 8 : -(-(bit + width) // 8)], "little")
    return (chunk >> (bit % 8)) & ((1 << width) - 1)


def log2(n: int, what: str = "count") -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"{what} is not a power of two")
    return n.bit_length() - 1
