"""Rings and disks on the pixel grid."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from spotlake.session import current


@lru_cache(4096)
def ring(radius: int, four_connected: bool = False) -> np.ndarray:
    """(dy, dx) rows of the midpoint circle, without repeats."""
    if radius == 0:
        return np.zeros((1, 2), dtype=np.int64)
    points = [(0, radius), (0, -radius), (radius, 0), (-radius, 0)]
    x, y = 1, -radius
    while x < -y:
        points += [(sy * b, sx * a) for a, b in ((x, y), (y, x)) for sy in (1, -1) for sx in (1, -1)]
        if x * x + y * y <= radius * radius:
            x += 1
        else:
            y += 1
            x += not four_connected
    if y == -x:
        points += [(sy * x, sx * x) for sy in (1, -1) for sx in (1, -1)]
    return np.unique(np.array(points, dtype=np.int64), axis=0)


@lru_cache(4096)
def disk(radius: int) -> np.ndarray:
    """(dy, dx) rows of the ring and all that lies between its left and right arcs."""
    edge = ring(radius)
    rows = []
    for dy in range(-radius, radius + 1):
        dx = edge[edge[:, 0] == dy, 1]
        rows.append(np.column_stack([np.full(dx.max() - dx.min() + 1, dy), np.arange(dx.min(), dx.max() + 1)]))
    return np.concatenate(rows)


def disk_mask(side: int, centre: tuple[int, int], radius: int) -> np.ndarray:
    """side x side booleans, true on the disk around centre (row, col), cut at the borders."""
    out = np.zeros((side, side), dtype=bool)
    p = disk(int(radius)) + np.array(centre)
    p = p[((p >= 0) & (p < side)).all(axis=1)]
    out[p[:, 0], p[:, 1]] = True
    return out


def _offsets(make, radii) -> DataFrame:
    rows = [(int(r), int(dy), int(dx)) for r in radii for dy, dx in make(int(r))]
    return current().createDataFrame(rows, "r int, dy int, dx int")


def disk_table(radii) -> DataFrame:
    """r, dy, dx for each of the radii (parameters, so few)."""
    return _offsets(disk, radii)


def ring_table(radii) -> DataFrame:
    return _offsets(ring, radii)


def window(y: int, x: int, side: int, height: int, width: int) -> tuple[int, int]:
    """Top and left of the side x side window around (y, x), slid to lie in the image."""
    if side > height or side > width:
        raise ValueError(f"a window of {side} pixels doesn't fit into an image of {height} x {width}")
    return min(max(y - side // 2, 0), height - side), min(max(x - side // 2, 0), width - side)
