"""Hybrid encoding of images to a budget of bytes.

Each unit has a palette record and, at each quality, a transform record. Pure
palette, pure transform and every state of the sweep between them are compared;
the least error within the budget wins, then the fewest bytes, then the first.
One image is one task; ``operators.transform.sweep`` is the same over relations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.operators.palette_encoder import Settings, compress
from tessella.sources import hybrid_file
from tessella.sources.bits import log2
from tessella.sources.hybrid_file import ORDER, PALETTE, TRANSFORM, UNIT, HybridImage

#: Default qualities and target of bits per pixel.
QUALITIES, TARGET = (25, 35, 45, 55, 65, 75, 85, 92), 4.0


@dataclass
class State:
    sse: int
    payload_bytes: int
    modes: np.ndarray
    quality: int | None


def _ue(v: np.ndarray) -> np.ndarray:
    return 2 * np.floor(np.log2(v + 1)).astype(np.int64) + 1


def _se(v: np.ndarray) -> np.ndarray:
    return _ue(np.where(v > 0, 2 * v - 1, -2 * v))


def record_bits(blocks: np.ndarray) -> np.ndarray:
    """Bits of each block (..., 64): the first value, a run and a value for every other that is not zero, an end bit."""
    along = blocks[..., ORDER]
    rest = along[..., 1:]
    used, at = rest != 0, np.arange(1, 64)
    last = np.maximum.accumulate(np.where(used, at, 0), axis=-1)
    before = np.concatenate([np.zeros(last.shape[:-1] + (1,), dtype=np.int64), last[..., :-1]], axis=-1)
    return _se(along[..., 0]) + 1 + np.where(used, 1 + _ue(np.maximum(0, at - before - 1)) + _se(rest), 0).sum(axis=-1)


def _unit_errors(rgb: np.ndarray, out: np.ndarray) -> np.ndarray:
    at = np.arange(rgb.shape[0])[:, None] // UNIT * -(-rgb.shape[1] // UNIT) + np.arange(rgb.shape[1])[None, :] // UNIT
    return np.bincount(at.ravel(), ((rgb.astype(np.int64) - out) ** 2).sum(axis=2).ravel()).astype(np.int64)


def _unit_sizes(height: int, width: int) -> np.ndarray:
    tall, wide = (np.minimum(UNIT, n - np.arange(0, n, UNIT)) for n in (height, width))
    return (tall[:, None] * wide[None, :]).ravel()


def _bytes(b0, b1, n0, n1, units: int, palette_bytes: int):
    up = lambda b: -(-b // 8)
    return (n0 > 0) * palette_bytes + (n1 > 0) * 128 + ((n0 > 0) & (n1 > 0)) * up(units) + up(b0) + up(b1)


def sweep_states(bits: np.ndarray, sse: np.ndarray, palette_bytes: int, quality: int) -> Iterator[State]:
    """States from the least error on; bits and sse are (2, units), row 0 palette and row 1 transform."""
    n = bits.shape[1]
    modes = ((sse[1] < sse[0]) | ((sse[1] == sse[0]) & (bits[1] < bits[0]))).astype(np.int64)
    u = np.arange(n)
    saved, lost = bits[modes, u] - bits[1 - modes, u], sse[1 - modes, u] - sse[modes, u]
    flips = np.nonzero((saved > 0) & (lost > 0))[0]
    flips = flips[np.lexsort((flips, lost[flips] / saved[flips]))]
    sign = 1 - 2 * modes[flips]
    total = lambda start, change: start + np.concatenate([[0], np.cumsum(change)])
    b0, b1 = total(bits[0][modes == 0].sum(), -sign * bits[0][flips]), total(bits[1][modes == 1].sum(), sign * bits[1][flips])
    n0, n1 = total((modes == 0).sum(), -sign), total((modes == 1).sum(), sign)
    errors, sizes = total(sse[modes, u].sum(), lost[flips]), _bytes(b0, b1, n0, n1, n, palette_bytes)
    for k in range(len(flips) + 1):
        if k:
            modes = modes.copy()
            modes[flips[k - 1]] ^= 1
        yield State(int(errors[k]), int(sizes[k]), modes, quality)


def choose(states: Iterator[State], budget: int) -> State:
    best = None
    for s in states:
        rank = (0, s.sse, s.payload_bytes) if s.payload_bytes <= budget else (1, s.payload_bytes, s.sse)
        if best is None or rank < best[0]:
            best = (rank, s)
    return best[1]


def encode(rgba: np.ndarray, target: float = TARGET, qualities: tuple[int, ...] = QUALITIES, settings: Settings | None = None, mode: str = "auto") -> tuple[HybridImage, State]:
    """The image and the state that was chosen; ``mode`` may be palette or transform to leave out the other."""
    if target <= 0 or mode not in ("auto", "palette", "transform") or any(not 1 <= q <= 100 for q in qualities):
        raise ValueError("bad target, mode or qualities")
    h, w = rgba.shape[:2]
    rgb, sizes = rgba[..., :3], _unit_sizes(h, w)
    n, palette, states = len(sizes), None, []
    if mode != "transform":
        s = settings or Settings(block=UNIT, local=8, shared=32, palettes=1 << min(64, n).bit_length() - 1, space="rgb", method="k-means")
        if s.block != UNIT:
            raise ValueError("palette blocks must be units")
        e = compress(rgba, s)
        palette = e.image
        bits0 = log2(s.palettes) + s.local * log2(s.shared) + sizes * log2(s.local)
        sse0, palette_bytes = _unit_errors(rgb, e.pixels), s.palettes * s.shared * s.color_bits // 8
        states.append([State(int(sse0.sum()), int(_bytes(bits0.sum(), 0, n, 0, n, palette_bytes)), np.full(n, PALETTE), None)])
    blocks = {}
    if mode != "palette":
        f = hybrid_file.transformed(rgb)
        for q in sorted(set(qualities)):
            tables = hybrid_file.quality_tables(q)
            blocks[q] = hybrid_file.quantise(f, tables)
            whole = hybrid_file.pixels(HybridImage(w, h, np.full(n, TRANSFORM), None, tables, blocks[q]))
            bits1, sse1 = record_bits(blocks[q]).sum(axis=1), _unit_errors(rgb, whole)
            states.append([State(int(sse1.sum()), int(_bytes(0, bits1.sum(), 0, n, n, 0)), np.full(n, TRANSFORM), q)])
            if mode == "auto":
                states.append(sweep_states(np.stack([bits0, bits1]), np.stack([sse0, sse1]), palette_bytes, q))
    best = choose((s for group in states for s in group), int(target * w * h / 8))
    tables = hybrid_file.quality_tables(best.quality) if best.quality is not None else None
    return HybridImage(w, h, best.modes, palette, tables, blocks.get(best.quality)), best


def encode_images(images: DataFrame, target: float = TARGET) -> DataFrame:
    """image_id, data, sse, payload_bytes, palette_units, transform_units and quality of each image (image_id, width, height, rgba)."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                image, s = encode(np.frombuffer(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4), target)
                rows.append({"image_id": r["image_id"], "data": hybrid_file.encode(image), "sse": s.sse, "payload_bytes": s.payload_bytes, "palette_units": int((s.modes == PALETTE).sum()), "transform_units": int((s.modes == TRANSFORM).sum()), "quality": s.quality})
            schema = pa.schema([("image_id", batch.schema.field(0).type), ("data", pa.binary()), ("sse", pa.int64()), ("payload_bytes", pa.int64()), ("palette_units", pa.int64()), ("transform_units", pa.int64()), ("quality", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return images.select("image_id", "width", "height", "rgba").mapInArrow(run, f"image_id {kind}, data binary, sse bigint, payload_bytes bigint, palette_units bigint, transform_units bigint, quality int")
