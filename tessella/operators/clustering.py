"""Colour clustering of weighted points: means, medians, medoids, and a uniform start.

All of it works on distinct colours in the order in which they were first seen;
that order decides ties. Groups are single images or single palettes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessella.sources.palette_file import from_lab, to_lab

METHODS = ("k-means", "k-medians", "k-medoids", "k-means-uniform")
SPACES = ("oklab", "rgb")
#: Pairs from which on the nearest are found by a product.
MANY = 1 << 14


def points_of(rgb: np.ndarray, space: str) -> np.ndarray:
    """Colours in the space where distances are taken; values beyond a byte are clipped for OKLab."""
    rgb = np.asarray(rgb, dtype=np.float64)
    return to_lab(np.clip(rgb, 0, 255)) if space == "oklab" else rgb


def distances(a: np.ndarray, b: np.ndarray, method: str = "k-means") -> np.ndarray:
    """(len(a), len(b)): city distance for medians, else squared."""
    if method == "k-medians":
        return np.abs(a[:, None] - b[None]).sum(axis=-1)
    # a component at a time, as three planes are read faster than a row of three for each pair
    out = a[:, 0, None] - b[:, 0]
    out *= out
    for c in (1, 2):
        d = a[:, c, None] - b[:, c]
        d *= d
        out += d
    return out


def nearest(a: np.ndarray, b: np.ndarray, method: str = "k-means", chunk: int = 1 << 16) -> np.ndarray:
    """Index of the nearest of ``b``, the first on ties, some rows at a time."""
    step = max(1, chunk // max(1, len(b)))
    if method != "k-medians" and 1 < len(b) <= 4096 and len(a) * len(b) >= MANY:
        return _nearest_of_many(a, b, step)
    return np.concatenate([distances(a[i : i + step], b, method).argmin(axis=1) for i in range(0, len(a), step)]) if len(a) else np.zeros(0, dtype=np.int64)


def _nearest_of_many(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """``nearest`` by one product in single precision; rows that its rounding leaves open are compared in full."""
    middle = (b.min(axis=0) + b.max(axis=0)) / 2
    p, q = np.ones((4, len(a)), dtype=np.float32), np.empty((len(b), 4), dtype=np.float32)
    p[:3] = (a - middle).T
    q[:, :3] = -2 * (b - middle)
    q[:, 3] = ((b - middle) ** 2).sum(axis=1)
    # beyond what rounding adds to two distances of this size: some units in the last place of the largest terms
    reach = np.abs(a - middle).max(), np.abs(b - middle).max()
    slack = np.float32(4e-6 * (2 * 3 * reach[0] * reach[1] + 3 * reach[1] ** 2))
    ones, places = np.ones(len(b), dtype=np.float32), np.arange(len(b), dtype=np.float32)
    out, met = np.empty(len(a), dtype=np.int64), np.empty(len(a), dtype=np.float32)
    for i in range(0, len(a), step):
        d = q @ p[:, i : i + step]
        within = (d <= d.min(axis=0) + slack).astype(np.float32)
        met[i : i + step] = ones @ within
        out[i : i + step] = places @ within  # the place of the only one, where there is one
    open_ = np.flatnonzero(met != 1)
    for i in range(0, len(open_), step):
        rows = open_[i : i + step]
        out[rows] = distances(a[rows], b).argmin(axis=1)
    return out


def histogram(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct colours of the pixels (n, 4) that are not transparent, first seen first, and their counts."""
    rgb = rgba[rgba[:, 3] != 0, :3].astype(np.int64)
    keys, first, counts = np.unique(rgb @ [65536, 256, 1], return_index=True, return_counts=True)
    order = np.argsort(first)
    keys = keys[order]
    return np.stack([keys >> 16, keys >> 8 & 255, keys & 255], axis=1), counts[order].astype(np.float64)


def spread_start(points: np.ndarray, weights: np.ndarray, k: int, method: str) -> np.ndarray:
    """The heaviest point, then each time the one with the largest distance times weight."""
    chosen = [int(weights.argmax())]
    near = np.full(len(points), np.inf)
    taken = np.zeros(len(points), dtype=bool)
    planes = np.asfortranarray(points)  # read a component at a time
    while len(chosen) < k:
        taken[chosen[-1]] = True
        near = np.minimum(near, distances(planes, points[[chosen[-1]]], method)[:, 0])
        worth = near * weights
        worth[taken] = -1
        chosen.append(int(worth.argmax()))
    return points[chosen]


def uniform_start(points: np.ndarray, k: int) -> np.ndarray:
    """Points nearest to cells of a cubic grid over their range, the cells chosen far apart."""
    low, high = points.min(axis=0), points.max(axis=0)
    n = 1
    while n**3 < k:
        n += 1
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    cells = low + (high - low) * (grid + 0.5) / n
    if k < len(cells):
        chosen, near = [0], np.full(len(cells), np.inf)
        while len(chosen) < k:
            near = np.minimum(near, distances(cells, cells[[chosen[-1]]])[:, 0])
            near[chosen] = -1
            chosen.append(int(near.argmax()))
        cells = cells[chosen]
    free, out = np.ones(len(points), dtype=bool), []
    for cell in cells[:k]:
        pick = int(np.where(free, distances(points, cell[None])[:, 0], np.inf).argmin())
        free[pick] = False
        out.append(pick)
    return points[out]


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """First value, in order, at which the running weight reaches half."""
    order = np.argsort(values, kind="stable")
    run = np.cumsum(weights[order])
    return float(values[order][min(len(order) - 1, int(np.searchsorted(run, run[-1] / 2, side="left")))])


def _centers(points: np.ndarray, weights: np.ndarray, own: np.ndarray, old: np.ndarray, method: str) -> np.ndarray:
    k, new = len(old), old.copy()
    total = np.bincount(own, weights, minlength=k)
    used = total > 0
    mean = np.stack([np.bincount(own, weights * points[:, c], minlength=k) for c in range(3)], axis=1)
    mean = np.where(used[:, None], mean / np.where(used, total, 1)[:, None], old)
    if method == "k-medians":
        for j in np.nonzero(used)[0]:
            mine = own == j
            new[j] = [weighted_median(points[mine, c], weights[mine]) for c in range(3)]
        return new
    if method == "k-medoids":
        best = medoids(points, weights, own, mean)
        new[used] = points[best[used]]
        return new
    return mean


def medoids(points: np.ndarray, weights: np.ndarray, own: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each cluster its member nearest to the center; on ties the heavier, then the first; -1 if empty."""
    d = ((points - centers[own]) ** 2) @ np.ones(3)
    order = np.lexsort((np.arange(len(points)), -weights, d, own))
    out = np.full(len(centers), -1)
    starts = np.unique(own[order], return_index=True)
    out[starts[0]] = order[starts[1]]
    return out


@dataclass
class Quantised:
    palette: np.ndarray  # (k, 3) bytes, most used first
    counts: np.ndarray
    colors: np.ndarray  # distinct colours
    slots: np.ndarray  # palette index of each distinct colour
    iterations: int


def quantise(colors: np.ndarray, counts: np.ndarray, k: int, method: str = "k-medoids", space: str = "oklab", diversity: float = 0.0, most: int = 24) -> Quantised:
    """Up to ``k`` colours for weighted distinct colours; weights are counts to the power 1 - diversity."""
    if method not in METHODS or space not in SPACES or not 0 <= diversity <= 1:
        raise ValueError("unknown method, space or diversity")
    if not len(colors):
        return Quantised(np.zeros((0, 3), dtype=np.uint8), np.zeros(0), colors, np.zeros(0, dtype=np.int64), 0)
    k = min(max(1, k), len(colors))
    points, weights = points_of(colors, space), counts if diversity == 0 else counts ** (1 - diversity)
    centers = uniform_start(points, k) if method == "k-means-uniform" else spread_start(points, weights, k, method)
    own, still, rounds = np.full(len(points), -1), 1e-8 if space == "oklab" else 0.01, 0
    while rounds < most:
        rounds += 1
        now = nearest(points, centers, method)
        changed, own = bool((now != own).any()), now
        new = _centers(points, weights, own, centers, method)
        step = np.abs(new - centers).sum() if method == "k-medians" else ((new - centers) ** 2).sum()
        centers = new
        if not changed or step < still:
            break
    own = nearest(points, centers, method)
    sizes = np.bincount(own, counts, minlength=k)
    if method == "k-medoids":
        rgb = colors[np.maximum(0, medoids(points, counts, own, centers))].astype(np.float64)
    else:
        rgb = from_lab(centers) if space == "oklab" else centers
    rgb = np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)
    order = np.lexsort((np.arange(k), -sizes))
    order = order[sizes[order] > 0]
    place = np.zeros(k, dtype=np.int64)
    place[order] = np.arange(len(order))
    return Quantised(rgb[order], sizes[order], colors, place[own], rounds)
