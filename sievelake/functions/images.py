"""Overlay regions in images: half-transparent or oddly frequent colours, as boxes with a confidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake import schemas

LEAST_AREA = 16
#: Pixels that are looked at together.
BLOCK = 1 << 20


def alpha_mask(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3]
    return (a > 0) & (a < 250)


def frequency_mask(rgba: np.ndarray) -> np.ndarray:
    """Colours, at five bits a channel, of more than 0.5 % and under 25 % of the pixels, less the commonest."""
    r, g, b = (rgba[..., i].astype(np.int32) >> 3 for i in range(3))
    key = (r << 10) | (g << 5) | b
    counts = np.bincount(key[rgba[..., 3] >= 10], minlength=1 << 15)
    chosen = (counts > key.size * 0.005) & (counts < key.size * 0.25)
    if counts.max(initial=0):
        ties = np.flatnonzero(counts == counts.max())
        if len(ties) > 1:
            # of equals the one that got there first
            flat = key[rgba[..., 3] >= 10]
            ties = sorted(ties, key=lambda k: np.flatnonzero(flat == k)[-1])
        chosen[ties[0]] = False
    return chosen[key]


def masks(rgba: np.ndarray) -> np.ndarray:
    """Of pictures of one size, by transparency, or by colours where that marks less than a thousandth."""
    found = alpha_mask(rgba)
    for i in np.flatnonzero(found.sum((1, 2)) < found[0].size * 0.001):
        found[i] = frequency_mask(rgba[i])
    return found


def components(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(root, row, start, end) of the runs of pixels in the rows: 8-connected ones have the same root, which is the first run of theirs."""
    # a blank column ends each row
    wide = found.shape[1] + 1
    flat = np.pad(found, ((0, 0), (0, 1))).ravel().astype(np.int8)
    edge = np.flatnonzero(np.diff(flat, prepend=0))
    starts, ends = edge[::2], edge[1::2]
    # runs of the row above that touch a run follow each other
    low, high = np.searchsorted(ends, starts - wide, "left"), np.searchsorted(starts, ends - wide, "right")
    n = np.maximum(high - low, 0)
    own = np.repeat(np.arange(len(starts)), n)
    above = np.arange(n.sum()) + np.repeat(low - (n.cumsum() - n), n)
    root = np.arange(len(starts))
    while True:
        a, b = root[own], root[above]
        apart = a != b
        if not apart.any():
            break
        # each root takes the least that it meets, so that their number halves at least
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    row = starts // wide
    return root, row, starts - row * wide, ends - row * wide


def regions_of(rgba: np.ndarray, threshold: float = 0.4) -> list[list[dict]]:
    """For each of pictures of one size the boxes of connected pixels by descending size; none at a threshold of 0."""
    out: list[list[dict]] = [[] for _ in rgba]
    if threshold <= 0 or not rgba.size:
        return out
    # one below the other, with a blank row between
    found = np.pad(masks(rgba), ((0, 0), (0, 1), (0, 0)))
    tall = found.shape[1]
    root, row, start, end = components(found.reshape(-1, found.shape[2]))
    if not len(root):
        return out
    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.diff(root[order], prepend=-1))
    over = lambda f, v: f.reduceat(v[order], first)
    area, x, x2, y, y2 = over(np.add, end - start), over(np.minimum, start), over(np.maximum, end), over(np.minimum, row), over(np.maximum, row) + 1
    w, h = x2 - x, y2 - y
    size = w * h
    # of one picture by size, of equals the first
    order = np.lexsort((-size, y // tall))
    for i in order[area[order] >= LEAST_AREA].tolist():
        confidence = round(min(1.0, 0.5 + 0.5 * int(area[i]) / int(size[i])), 3)
        if confidence >= threshold:
            out[y[i] // tall].append({"x": int(x[i]), "y": int(y[i] % tall), "width": int(w[i]), "height": int(h[i]), "confidence": confidence})
    return out


def regions(rgba: np.ndarray, threshold: float = 0.4) -> list[dict]:
    """Of one picture."""
    return regions_of(rgba[None], threshold)[0]


def to_rgba(raw: np.ndarray) -> np.ndarray:
    """From the pixels of Spark's image source, which has blue first."""
    channels = raw.shape[-1]
    if channels == 1:
        rgb, a = np.repeat(raw, 3, -1), None
    else:
        rgb, a = raw[..., 2::-1], raw[..., 3:] if channels == 4 else None
    return np.concatenate([rgb, np.full((*raw.shape[:-1], 1), 255, np.uint8) if a is None else a], -1)


def found_in(pictures: list[tuple[bytes, tuple[int, int, int]]], threshold: float) -> list[list[dict]]:
    """Regions of (rows of pixels, (height, width, channels)); pictures of one size are looked at together, up to BLOCK pixels at once."""
    out: list[list[dict]] = [[] for _ in pictures]
    sizes: dict[tuple[int, int, int], list[int]] = {}
    for i, (data, size) in enumerate(pictures):
        if len(data) != size[0] * size[1] * size[2]:
            raise ValueError(f"a picture of {size} has {len(data)} bytes")
        sizes.setdefault(size, []).append(i)
    for size, which in sizes.items():
        each = max(1, BLOCK // max(1, size[0] * size[1]))
        for k in range(0, len(which), each):
            some = which[k : k + each]
            raw = np.frombuffer(b"".join(pictures[i][0] for i in some), np.uint8).reshape(len(some), *size)
            for i, r in zip(some, regions_of(to_rgba(raw), threshold), strict=True):
                out[i] = r
    return out


def detector(threshold: float = 0.4):
    """A UDF of the fields data, height, width and nChannels of Spark's image struct."""

    @F.pandas_udf(f"array<{schemas.REGION}>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            whole = [None if d is None or n not in (1, 3, 4) or h <= 0 else (bytes(d), (int(h), int(w), int(n))) for d, h, w, n in zip(*columns, strict=True)]
            regions = iter(found_in([p for p in whole if p], threshold))
            yield pd.Series([None if p is None else next(regions) for p in whole])

    return run


def detect_regions(image: Column, threshold: float = 0.4) -> Column:
    """Regions of a column of Spark's image struct; null for a null or invalid image."""
    return detector(threshold)(image["data"], image["height"], image["width"], image["nChannels"])
