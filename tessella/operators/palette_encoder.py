"""Encoding of images with shared palettes and short tables for each block.

Blocks are clustered by what they contain, each cluster gets a palette, each
block a table of entries, each pixel a slot. Refinement moves the palettes to
the pixels that use them and builds the tables again, as long as that lowers the
error. One image is one task; images are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.operators.clustering import Quantised, distances, histogram, nearest, points_of, quantise
from tessella.operators.pixels import BAYER_2, BAYER_4, BAYER_STRENGTH
from tessella.sources import palette_file
from tessella.sources.palette_file import PaletteImage, stored_colors

#: Pixels from which one palette is made.
SAMPLE = 32768


@dataclass
class Settings:
    block: int = 8
    local: int = 8
    shared: int = 64
    palettes: int = 1
    color_bits: int = 24
    space: str = "oklab"
    method: str = "k-medoids"
    dithering: str = "none"  # or bayer-2, bayer-4, diffusion
    diversity: float = 0.0
    passes: int = 4

    def __post_init__(self) -> None:
        for n in (self.block, self.local, self.shared, self.palettes):
            palette_file.log2(n)
        if not (2 <= self.block <= 64 and 2 <= self.shared <= 256 and self.palettes <= 128 and 2 <= self.local <= min(16, self.shared, self.block**2) and 0 <= self.passes <= 16):
            raise ValueError("settings out of range")
        if self.dithering not in ("none", "bayer-2", "bayer-4", "diffusion"):
            raise ValueError("unknown dithering")


@dataclass
class Encoded:
    image: PaletteImage
    pixels: np.ndarray
    mse: float
    errors: list[float] = field(default_factory=list)


def block_rows(rgba: np.ndarray, block: int) -> tuple[np.ndarray, int, int]:
    """Block number of each pixel, blocks across and blocks in all."""
    h, w = rgba.shape[:2]
    across, down = -(-w // block), -(-h // block)
    return np.arange(h)[:, None] // block * across + np.arange(w)[None, :] // block, across, across * down


def descriptors(rgba: np.ndarray, block: int, space: str) -> np.ndarray:
    """(blocks, 6): mean and half the deviation of each component over the pixels that are not transparent."""
    at, _, blocks = block_rows(rgba, block)
    solid = rgba[..., 3] != 0
    own, p = at[solid], points_of(rgba[solid][:, :3], space)
    n = np.maximum(1, np.bincount(own, minlength=blocks))[:, None]
    mean = np.stack([np.bincount(own, p[:, c], minlength=blocks) for c in range(3)], axis=1) / n
    square = np.stack([np.bincount(own, p[:, c] ** 2, minlength=blocks) for c in range(3)], axis=1) / n
    return np.concatenate([mean, np.sqrt(np.maximum(0, square - mean**2)) * 0.5], axis=1)


def cluster_blocks(d: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Cluster of each block: starts spread out from the first block, then at most ``rounds`` steps of k-means."""
    far = lambda c: ((d - c) ** 2).sum(axis=1)
    chosen, near = [0], far(d[0])
    while len(chosen) < min(k, len(d)):
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        near = np.minimum(near, far(d[chosen[-1]]))
    centers, own = d[chosen].copy(), np.zeros(len(d), dtype=np.int64)
    for _ in range(rounds):
        now = np.stack([far(c) for c in centers], axis=1).argmin(axis=1)
        changed, own = bool((now != own).any()), now
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, d[:, c], minlength=len(centers)) for c in range(d.shape[1])], axis=1)
        new = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centers)
        step, centers = ((new - centers) ** 2).sum(), new
        if not changed or step < 1e-12:
            break
    return own


@lru_cache(maxsize=32)
def _quantised(pixels: bytes, shared: int, method: str, space: str, diversity: float) -> Quantised:
    """Colours of pixels of 4 bytes; settings that differ in tables or colour depth only take them from the one before."""
    return quantise(*histogram(np.frombuffer(pixels, dtype=np.uint8).reshape(-1, 4)), shared, method, space, diversity, 16)


def build_palettes(rgba: np.ndarray, selectors: np.ndarray, s: Settings) -> tuple[np.ndarray, list[int]]:
    """(palettes, shared, 3) bytes, short ones padded with their first colour, and how many are in use in each."""
    at = block_rows(rgba, s.block)[0]
    out, active = np.zeros((s.palettes, s.shared, 3), dtype=np.uint8), []
    for k in range(s.palettes):
        mine = rgba[selectors[at] == k]
        q = _quantised(mine[:: max(1, -(-len(mine) // SAMPLE))].tobytes(), s.shared, s.method, s.space, s.diversity)
        colors = stored_colors(q.palette, s.color_bits) if len(q.palette) else np.zeros((1, 3), dtype=np.uint8)
        out[k] = colors[0]
        out[k, : len(colors)] = colors
        active.append(len(colors))
    return out, active


def pool_width(active: int, local: int) -> int:
    """Neighbours of a picked entry that may take its place."""
    return min(active - 1, max(4, min(8, local)))


def neighbours(entries: np.ndarray, most: int) -> np.ndarray:
    """For each entry the ``most`` others nearest to it, the first on ties."""
    order = np.argsort(distances(entries, entries), axis=1, kind="stable")
    others = order[order != np.arange(len(entries))[:, None]].reshape(len(entries), -1)
    return others[:, :most]


def choose_table(own: np.ndarray, points: np.ndarray, entries: np.ndarray, beside: np.ndarray, local: int) -> np.ndarray:
    """Entries for a block whose pixels at ``points`` are nearest to palette entries ``own``.

    ``beside`` holds the ``neighbours`` of each entry, as many as ``pool_width`` says.
    Entries in use are replaced by the mean of the pixels that use them. A greedy
    choice by total error is followed by up to four exchanges, each the best one,
    with entries in use, their neighbours and those near the block's own centers;
    free places go to entries near the most demanded means.
    """
    active = len(entries)
    if not len(own):
        return np.zeros(local, dtype=np.int64)
    counts = np.bincount(own, minlength=active)
    used = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    counts = counts[used].astype(np.float64)
    rank = np.zeros(active, dtype=np.int64)
    rank[used] = np.arange(len(used))
    means = np.stack([np.bincount(rank[own], points[:, c], minlength=len(used)) for c in range(3)], axis=1) / counts[:, None]
    d = distances(means, entries)  # (used, active)
    picked = list(used)
    if len(used) > local:
        picked, near, mutual = [], np.full(len(used), np.inf), np.ascontiguousarray(d[:, used])
        free = np.ones(len(used), dtype=bool)
        for _ in range(local):
            error = counts @ np.minimum(near[:, None], mutual)
            k = int(np.where(free, error, np.inf).argmin())
            free[k] = False
            picked.append(used[k])
            near = np.minimum(near, mutual[:, k])
    pool = np.zeros(active, dtype=bool)
    pool[used] = pool[beside[picked]] = True
    centers = entries[picked].copy()
    for _ in range(6):
        mine = nearest(means, centers)
        total = np.bincount(mine, counts, minlength=len(centers))
        sums = np.stack([np.bincount(mine, counts * means[:, c], minlength=len(centers)) for c in range(3)], axis=1)
        new = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centers)
        step, centers = ((new - centers) ** 2).sum(), new
        if step < 1e-8:
            break
    pool[np.argsort(distances(centers, entries), axis=1, kind="stable")[:, :local]] = True
    rows = np.arange(len(used))
    for _ in range(4):
        now = d[:, picked]
        least = now.argmin(axis=1)
        near = now[rows, least]
        best = (float(counts @ near), -1, -1)
        now[rows, least] = np.inf
        second = now.min(axis=1)  # what a pixel falls back to when its nearest entry goes
        open_ = pool.copy()
        open_[picked] = False
        others = np.flatnonzero(open_)
        given = np.ascontiguousarray(d[:, others])
        for slot in range(len(picked)) if len(others) else ():
            error = counts @ np.minimum(np.where(least == slot, second, near)[:, None], given)
            k = int(error.argmin())
            if error[k] < best[0] or (error[k] == best[0] and best[1] >= 0 and others[k] < best[2]):
                best = (float(error[k]), slot, int(others[k]))
        if best[1] < 0:
            break
        picked[best[1]] = best[2]
    support = np.array([float(u in picked) for u in used])
    free = np.ones(active, dtype=bool)
    free[picked] = False
    while len(picked) < min(local, active):
        k = int((np.maximum(1, counts) / (support + 1)).argmax())
        e = int(np.where(free, d[k], np.inf).argmin())
        picked.append(e)
        free[e] = False
        support[k] += 1
    return np.array(picked + [picked[0]] * (local - len(picked)))


def _tables(rgba: np.ndarray, palette: np.ndarray, active: list[int], selectors: np.ndarray, s: Settings) -> np.ndarray:
    at, across, blocks = block_rows(rgba, s.block)
    entries = [points_of(p[:n], s.space) for p, n in zip(palette, active, strict=True)]
    beside = [neighbours(e, pool_width(len(e), s.local)) for e in entries]
    table = np.zeros((blocks, s.local), dtype=np.int64)
    h, w = at.shape
    for b in range(blocks):
        ys, xs = slice(b // across * s.block, min(h, (b // across + 1) * s.block)), slice(b % across * s.block, min(w, (b % across + 1) * s.block))
        solid = rgba[ys, xs].reshape(-1, 4)
        p = points_of(solid[solid[:, 3] != 0][:, :3], s.space)
        k = selectors[b]
        table[b] = choose_table(nearest(p, entries[k]), p, entries[k], beside[k], s.local)
    return table


def diffuse(rgba: np.ndarray, entries: np.ndarray, colors: np.ndarray, s: Settings) -> np.ndarray:
    """Slots of a block, or of an image, with each pixel's error passed on to its neighbours (7, 3, 5, 1 of 16)."""
    h, w = rgba.shape[:2]
    slots, error = np.zeros((h, w), dtype=np.int64), np.zeros((h + 1, w + 2, 3))
    for y in range(h):
        for x in range(w):
            if rgba[y, x, 3] == 0:
                continue
            want = np.clip(rgba[y, x, :3] + error[y, x + 1], 0, 255)
            slots[y, x] = k = int(nearest(points_of(want[None], s.space), entries)[0])
            left = want - colors[k]
            error[y, x + 2] += left * 7 / 16
            error[y + 1, x] += left * 3 / 16
            error[y + 1, x + 1] += left * 5 / 16
            error[y + 1, x + 2] += left / 16
    return slots


def _slots(rgba: np.ndarray, palette: np.ndarray, selectors: np.ndarray, table: np.ndarray, s: Settings) -> np.ndarray:
    at, across, blocks = block_rows(rgba, s.block)
    h, w = at.shape
    colors = palette[selectors[:, None], table]  # (blocks, local, 3)
    entries = points_of(colors, s.space)
    if s.dithering == "diffusion":
        out = np.zeros((h, w), dtype=np.int64)
        for b in range(blocks):
            ys, xs = slice(b // across * s.block, (b // across + 1) * s.block), slice(b % across * s.block, (b % across + 1) * s.block)
            out[ys, xs] = diffuse(rgba[ys, xs], entries[b], colors[b].astype(np.float64), s)
        return out
    shift = 0.0
    if s.dithering != "none":
        n = int(s.dithering[-1])
        matrix = np.array(BAYER_2 if n == 2 else BAYER_4).reshape(n, n)
        shift = (((matrix + 0.5) / (n * n) - 0.5) * BAYER_STRENGTH)[np.arange(h)[:, None] % n, np.arange(w)[None, :] % n][..., None]
    p = points_of(rgba[..., :3] + shift, s.space).reshape(-1, 3)
    out, flat = np.zeros(h * w, dtype=np.int64), at.ravel()
    for i in range(0, h * w, 1 << 16):
        own = entries[flat[i : i + (1 << 16)]]
        out[i : i + (1 << 16)] = ((p[i : i + (1 << 16), None] - own) ** 2).sum(axis=-1).argmin(axis=1)
    return out.reshape(h, w)


def _error(rgba: np.ndarray, out: np.ndarray) -> float:
    solid = rgba[..., 3] != 0
    return float(((rgba[solid][:, :3].astype(np.int64) - out[solid]) ** 2).mean()) if solid.any() else 0.0


def _moved(rgba: np.ndarray, image: PaletteImage, s: Settings) -> np.ndarray:
    """Palettes moved to the means of their pixels, or to the pixel nearest to that mean."""
    at, solid = image.block_of(), rgba[..., 3] != 0
    entry = (image.selectors[at] * s.shared + image.table[at, image.slots()])[solid]
    rgb, n = rgba[solid][:, :3].astype(np.int64), s.palettes * s.shared
    count = np.bincount(entry, minlength=n)
    mean = np.stack([np.bincount(entry, rgb[:, c], minlength=n) for c in range(3)], axis=1) / np.maximum(1, count)[:, None]
    new = np.floor(mean + 0.5)
    if s.method == "k-medoids" and len(entry):
        d = ((rgb - mean[entry]) ** 2).sum(axis=1)
        order = np.lexsort((rgb @ [65536, 256, 1], d, entry))
        which, first = np.unique(entry[order], return_index=True)
        new[which] = rgb[order[first]]
    flat = image.palette.reshape(-1, 3).copy()
    flat[count > 0] = stored_colors(np.clip(new[count > 0], 0, 255), s.color_bits)
    return flat.reshape(image.palette.shape)


def compress(rgba: np.ndarray, s: Settings | None = None) -> Encoded:
    """An image (height, width, 4) of bytes as a palette image."""
    s = s or Settings()
    h, w = rgba.shape[:2]
    _, _, blocks = block_rows(rgba, s.block)
    selectors = np.zeros(blocks, dtype=np.int64) if s.palettes == 1 else cluster_blocks(descriptors(rgba, s.block, s.space), s.palettes)
    palette, active = build_palettes(rgba, selectors, s)

    def finish(colors: np.ndarray) -> Encoded:
        table = _tables(rgba, colors, active, selectors, s)
        direct = s.local == s.block**2
        slots = _slots(rgba, colors, selectors, table, s)
        image = PaletteImage(w, h, s.block, colors, selectors, table, slots, s.color_bits)
        if direct:
            # slots are implied by place, so each block's table is its pixels in order
            at = image.block_of()
            place = np.arange(h)[:, None] % s.block * s.block + np.arange(w)[None, :] % s.block
            full = table.copy()
            full[at, place] = table[at, slots]
            image = PaletteImage(w, h, s.block, colors, selectors, full, None, s.color_bits)
        out = image.pixels()
        return Encoded(image, out, _error(rgba, out))

    best = finish(palette)
    best.errors = errors = [best.mse]
    for _ in range(s.passes):
        tried = finish(_moved(rgba, best.image, s))
        errors.append(min(tried.mse, errors[-1]))
        if tried.mse >= best.mse:
            break
        best = tried
    best.errors = errors
    return best


def encode_images(images: DataFrame, s: Settings | None = None) -> DataFrame:
    """image_id, data (the file), mse and passes of each image (image_id, width, height, rgba)."""
    s = s or Settings()
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, errors, passes = [], [], []
            for row in batch.to_pylist():
                e = compress(np.frombuffer(row["rgba"], dtype=np.uint8).reshape(row["height"], row["width"], 4), s)
                files.append(palette_file.encode(e.image))
                errors.append(e.mse)
                passes.append(len(e.errors) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary()), pa.array(errors, pa.float64()), pa.array(passes, pa.int32())], names=["image_id", "data", "mse", "passes"])

    return images.select("image_id", "width", "height", "rgba").mapInArrow(run, f"image_id {kind}, data binary, mse double, passes int")
