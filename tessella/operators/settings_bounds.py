"""Errors of an image under many palette settings, encoding only those that may be the least.

No table of ``local`` entries a block does better than bounds that cost less than
finding one. Settings whose bound is above an error already found cannot be the
least and are not encoded; where no block uses more than ``local`` entries the
encoder keeps them all, so that the error is known without tables.
All colours are compared in RGB and palettes are not refined (``passes=0``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessella.operators import palette_encoder
from tessella.operators.palette_encoder import Settings, block_rows, build_palettes, cluster_blocks, descriptors

#: Blocks over which colours are compared in pairs have at most this many pixels a side.
PAIRED = 8
#: Side of the squares of whole blocks that are bounded at once, whatever the size of an image.
TILE = 128
#: Steps by which a bound is raised.
STEPS = 24


def _shares(rgba: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """What a pixel pays at least in a cluster of 1, 2, ... pixels of its block: (blocks, pixels, sizes), and which are solid."""
    h, w = rgba.shape[:2]
    down, across = -(-h // block), -(-w // block)
    px = np.zeros((down * block, across * block, 4), dtype=np.float32)
    px[:h, :w] = rgba
    px = px.reshape(down, block, across, block, 4).swapaxes(1, 2).reshape(down * across, block * block, 4)
    solid = px[..., 3] != 0
    d = np.zeros((*solid.shape, solid.shape[1]), dtype=np.float32)  # whole numbers below 2**24, so nothing is rounded
    for c in range(3):
        part = px[:, :, None, c] - px[:, None, :, c]
        part *= part
        d += part
    d[~(solid[:, :, None] & solid[:, None, :])] = np.inf
    own = np.arange(solid.shape[1])
    d[:, own, own] = 0  # a pixel itself comes first and adds nothing
    d.sort(axis=2)
    return np.cumsum(d, axis=2, dtype=np.float64) / (2 * (own + 1)), solid


def free_bound(shares: np.ndarray, solid: np.ndarray, local: int) -> float:
    """No ``local`` colours a block, whatever they are, have less squared error in all.

    A cluster of m pixels costs the sum of squared distances of all its pairs over m,
    so each of its pixels pays at least half of those to its m - 1 nearest pixels of
    the block, over m. The sizes that pixels choose are held to ``local`` clusters by
    a price on 1 / m for each block. Larger blocks cost no less than their parts.
    """
    size = np.arange(1, solid.shape[1] + 1)
    weight = solid.astype(np.float64)
    best, low = np.zeros(len(solid)), np.zeros(len(solid))
    high = np.where(np.isfinite(shares), shares, 0).max(axis=(1, 2)) * len(size) + 1
    for _ in range(STEPS // 2):
        price = (low + high) / 2
        cost = shares + (price[:, None] / size)[:, None]
        m = cost.argmin(axis=2)
        least = np.take_along_axis(cost, m[..., None], axis=2)[..., 0]
        best = np.maximum(best, (least * weight).sum(axis=1) - price * local)
        many = (weight / (m + 1)).sum(axis=1) > local
        low, high = np.where(many, price, low), np.where(many, high, price)
    return float(best.sum())


def _to_palette(rgba: np.ndarray, colors: np.ndarray, active: list[int], selectors: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each solid pixel to the entries of its block's palette, block after block, and where blocks begin.

    They come from a product of whole numbers below 2**24, so nothing is rounded.
    """
    at, solid = block_rows(rgba, block)[0].ravel(), rgba[..., 3].ravel() != 0
    order = np.flatnonzero(solid)
    order = order[np.argsort(at[order], kind="stable")]
    own, rgb = at[order], rgba.reshape(-1, 4)[order, :3].astype(np.float32)
    p = np.concatenate([rgb, (rgb * rgb).sum(axis=1, keepdims=True), np.ones((len(rgb), 1), dtype=np.float32)], axis=1)
    d = np.empty((len(order), colors.shape[1]), dtype=np.float32)
    chosen = selectors[own]
    for k, (entries, n) in enumerate(zip(colors.astype(np.float32), active, strict=True)):
        q = np.concatenate([-2 * entries.T, np.ones((1, len(entries)), dtype=np.float32), (entries * entries).sum(axis=1)[None]])
        rows = chosen == k if len(colors) > 1 else slice(None)
        d[rows] = p[rows] @ q
        if n < len(entries):
            d[rows, n:] = np.inf
    return d, np.flatnonzero(np.diff(own, prepend=-1))


def table_bound(d: np.ndarray, starts: np.ndarray, local: int, enough: float) -> tuple[float, bool]:
    """Least squared error of any ``local`` entries a block, and whether an encoding has just this error.

    Each pixel is given a budget; a block costs at least its budgets less what its
    ``local`` best entries leave over of them. Budgets are raised where no such entry
    is within them and lowered where several are, until the bound passes ``enough``.
    """
    if not len(d):
        return 0.0, True
    nearest, counts = d.argmin(axis=1), np.diff(starts, append=len(d))
    least = d[np.arange(len(d)), nearest]
    block = np.repeat(np.arange(len(starts)), counts)
    met = np.zeros((len(starts), d.shape[1]), dtype=bool)
    met[block, nearest] = True
    used = met.sum(axis=1)
    bound = np.add.reduceat(least.astype(np.float64), starts)
    if (used <= local).all() or bound.sum() > enough:
        return float(bound.sum()), bool((used <= local).all())
    tight = used > local
    settled, best = bound[~tight].sum(), bound[tight]
    rows = tight[block]
    if not rows.all():
        d, least = d[rows], least[rows]
    counts = counts[tight]
    block, starts = np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = min(d.shape[1] - 1, -(-int(np.median(used[tight])) // local))
    budget = np.partition(d, rank, axis=1)[:, rank]
    budget = np.where(np.isfinite(budget), budget, least)
    above = 1 + counts * 2.0**-22  # sums of single precision are below the true ones by less
    over, step = np.empty_like(d), np.float32(0.3)
    for _ in range(STEPS):
        np.subtract(budget[:, None], d, out=over)
        np.maximum(over, 0, out=over)
        gain = np.add.reduceat(over, starts, axis=0)
        top = np.argpartition(-gain, local - 1, axis=1)[:, :local]
        left = np.take_along_axis(gain, top, axis=1).sum(axis=1, dtype=np.float64) * above
        best = np.maximum(best, np.add.reduceat(budget.astype(np.float64), starts) - left)
        if settled + best.sum() > enough:
            break
        within = (np.take_along_axis(over, top[block], axis=1) > 0).sum(axis=1)
        budget = np.maximum(least, budget * (1 + step * np.clip(1 - within, -1, 1).astype(np.float32)))
        step *= np.float32(0.9)
    return float(settled + best.sum()), False


def _tiles(rgba: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for y in range(0, rgba.shape[0], TILE):
        for x in range(0, rgba.shape[1], TILE):
            yield y, x, rgba[y : y + TILE, x : x + TILE]


def _free_bounds(rgba: np.ndarray, block: int, local: set[int]) -> dict[int, float]:
    out = dict.fromkeys(local, 0.0)
    for _, _, part in _tiles(rgba):
        shares = _shares(part, block)
        for k in local:
            out[k] += free_bound(*shares, k)
    return out


def _bound(rgba: np.ndarray, colors: np.ndarray, active: list[int], selectors: np.ndarray, s: Settings, a_pixel: float) -> tuple[float, bool]:
    """``table_bound`` of an image, raised until each of its parts passes ``a_pixel`` for each solid pixel."""
    at, total, all_met = selectors.reshape(-(-rgba.shape[0] // s.block), -1), 0.0, True
    for y, x, part in _tiles(rgba):
        own = at[y // s.block : (y + TILE) // s.block, x // s.block : (x + TILE) // s.block].ravel()
        d, starts = _to_palette(part, colors, active, own, s.block)
        bound, met = table_bound(d, starts, s.local, a_pixel * len(d) * (1 + 1e-9))
        total, all_met = total + bound, all_met and met
    return total, all_met


def _error_of(total: float, rgba: np.ndarray) -> int:
    """Squared error over all pixels, the mean of the solid ones standing for the others."""
    n = int((rgba[..., 3] != 0).sum())
    mse = float(total / (n * 3)) if n else 0.0
    return round(mse * rgba.shape[0] * rgba.shape[1] * 3)


def least_errors(rgba: np.ndarray, tried: list[dict]) -> list[int | None]:
    """Error of an image (height, width, 4) for each of ``tried``, or None where it cannot be the least.

    ``tried`` holds settings (block, local, shared, palettes, bits), whether each is
    of the baseline's ``family`` and whether its rate is ``inside`` the window. Of
    those inside, the least errors of all and of the family are sought, and whatever
    equals them is given too; rows not inside are ranked by rate and all encoded.
    """
    errors: list[int | None] = [None] * len(tried)
    best = {True: np.inf, False: np.inf}  # of the family, and of all
    selectors: dict[tuple[int, int], np.ndarray] = {}
    frees: dict[tuple[int, int], float] = {}
    solid = max(1, int((rgba[..., 3] != 0).sum()))
    scale = rgba.shape[0] * rgba.shape[1] / solid
    paired = lambda t: min(t["block"], PAIRED)

    def judge(t: dict) -> int | None:
        s = Settings(block=t["block"], local=t["local"], shared=t["shared"], palettes=t["palettes"], color_bits=t["bits"], passes=0, space="rgb", method="k-means")
        if t["inside"]:
            # beyond this a row's error is larger than one known, however it is rounded
            most = (best[t["family"]] + 2) / scale * (1 + 1e-9)
            if most < np.inf:
                if (paired(t), s.local) not in frees:
                    own = {o["local"] for o in tried if o["inside"] and paired(o) == paired(t)}
                    frees.update(((paired(t), k), v) for k, v in _free_bounds(rgba, paired(t), own).items())
                if frees[paired(t), s.local] > most:
                    return None
            shape = (s.block, s.palettes)
            if shape not in selectors:
                blocks = block_rows(rgba, s.block)[2]
                selectors[shape] = np.zeros(blocks, dtype=np.int64) if s.palettes == 1 else cluster_blocks(descriptors(rgba, s.block, s.space), s.palettes)
            bound, met = _bound(rgba, *build_palettes(rgba, selectors[shape], s), selectors[shape], s, most / solid)
            if bound > most:
                return None
            if met:
                return _error_of(bound, rgba)
        return round(palette_encoder.compress(rgba, s).mse * rgba.shape[0] * rgba.shape[1] * 3)

    # many colours a block and few palette entries first: their errors are small and often known without tables
    for i in sorted(range(len(tried)), key=lambda i: (-tried[i]["local"], *(tried[i][k] for k in ("palettes", "shared", "block", "bits")), i)):
        t = tried[i]
        errors[i] = judge(t)
        if t["inside"] and errors[i] is not None:
            best[False] = min(best[False], errors[i])
            if t["family"]:
                best[True] = min(best[True], errors[i])
    return errors
