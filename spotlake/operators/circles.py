"""The circle detector: edges, candidates through three edge pixels, scores along the perimeter, greedy choice. Runs on one plane in numpy."""

from __future__ import annotations

import numpy as np

from spotlake.operators.geometry import ring

CHUNK = 250_000


def to_uint8(image: np.ndarray) -> np.ndarray:
    shifted = image.astype(np.float64) - image.min()
    top = shifted.max()
    return (255 * shifted / top).astype(np.uint8) if top > 0 else np.zeros(image.shape, dtype=np.uint8)


def _weighted(image: np.ndarray, column: tuple, row: tuple) -> np.ndarray:
    """Separable correlation with borders mirrored without repeating the border pixel."""
    k, m = len(column) // 2, len(row) // 2
    padded = np.pad(image, ((k, k), (m, m)), mode="reflect")
    h, w = image.shape
    tall = sum(c * padded[i : i + h] for i, c in enumerate(column))
    return sum(c * tall[:, i : i + w] for i, c in enumerate(row))


def smooth(image: np.ndarray) -> np.ndarray:
    """5 x 5 Gaussian, weights 1 4 6 4 1 over 16 both ways, to whole numbers."""
    w = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
    return np.rint(_weighted(image.astype(np.float64), w, w))


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scharr derivatives by y and x."""
    side, middle = (3.0, 10.0, 3.0), (-1.0, 0.0, 1.0)
    return _weighted(image, middle, side), _weighted(image, side, middle)


def maxima(dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of the gradient, and where it is a local maximum across the edge."""
    size = np.hypot(dy, dx)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda oy, ox: p[1 + oy : 1 + oy + h, 1 + ox : 1 + ox + w]
    ay, ax = np.abs(dy), np.abs(dx)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    same = (dy < 0) == (dx < 0)
    peak = np.select(
        [flat, steep, same],
        [(size > at(0, -1)) & (size >= at(0, 1)), (size > at(-1, 0)) & (size >= at(1, 0)), (size > at(-1, -1)) & (size > at(1, 1))],
        (size > at(-1, 1)) & (size > at(1, -1)),
    )
    return size, peak


def flood(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """strong, and all of weak that connects to it."""
    kept, front = strong, strong
    while front.any():  # neighbours of what was reached last, all at once
        p = np.pad(front, 1)
        wide = p[:-2] | p[1:-1] | p[2:]
        front = (wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:]) & weak & ~kept
        kept = kept | front
    return kept


def canny(dy: np.ndarray, dx: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges: local maxima of the gradient across it above low that connect to ones above high."""
    size, peak = maxima(dy, dx)
    weak = peak & (size > low)
    return flood(weak & (size > high), weak)


def thresholds(dy: np.ndarray, dx: np.ndarray, low_quantile: float, high_quantile: float) -> np.ndarray:
    """Quantiles, interpolated, of the gradient's length."""
    return np.quantile(np.hypot(dy, dx), [low_quantile, high_quantile])


def by_cell(edges: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the edge pixels, cell after cell of the grid; where each cell with any begins, and how many it has."""
    y, x = np.nonzero(edges)
    key = (y // cell) * (edges.shape[1] // cell + 1) + x // cell
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(y) else np.zeros(0, dtype=np.int64)
    return y[order], x[order], starts, np.diff(np.append(starts, len(y)))


def within(circles: np.ndarray, low: float, high: float, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Circles of a radius in low..high before rounding (half to even), at least partly in the image, as whole numbers; and their indices."""
    at = np.flatnonzero((circles[:, 2] >= low) & (circles[:, 2] <= high))
    c = np.rint(circles[at]).astype(np.int64)
    y, x, r = c.T
    inside = (y + r >= 0) & (y - r < shape[0]) & (x + r >= 0) & (x - r < shape[1])
    return c[inside], at[inside]


def candidates(edges: np.ndarray, n: int, cell: int, rng: np.random.Generator) -> np.ndarray:
    """n circles (row, col, radius) through an edge pixel and two more from its cell of the grid."""
    y, x, starts, counts = by_cell(edges, cell)
    if not len(y):
        return np.zeros((0, 3))
    y, x = y.astype(np.float64), x.astype(np.float64)
    cell_of = np.repeat(np.arange(len(starts)), counts)
    a = rng.integers(0, len(y), n)
    b, c = (starts[cell_of[a]] + (rng.random(n) * counts[cell_of[a]]).astype(np.int64) for _ in range(2))
    by, bx, cy, cx = y[b] - y[a], x[b] - x[a], y[c] - y[a], x[c] - x[a]
    twice = 2 * (bx * cy - by * cx)
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(divide="ignore", invalid="ignore"):
        oy, ox = (bx * cc - cx * bb) / twice, (cy * bb - by * cc) / twice
    fine = twice != 0
    return np.column_stack([y[a] + oy, x[a] + ox, np.hypot(oy, ox)])[fine]


def distinct_candidates(
    edges: np.ndarray, n: int, cell: int, rng: np.random.Generator, low: float, high: float, shape: tuple[int, int], origin: tuple[int, int] = (0, 0)
) -> np.ndarray:
    """n candidates without repeats and those that are not within() a plane of this shape, of which edges are a part that begins at origin."""
    found = np.zeros((0, 3), dtype=np.int64)
    for lo in range(0, n, CHUNK):
        c = candidates(edges, min(CHUNK, n - lo), cell, rng) + [*origin, 0]
        found = np.unique(np.concatenate([found, within(c, low, high, shape)[0]]), axis=0)
    return found


def rank(circles: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indices of the circles, best first."""
    return np.lexsort((circles[:, 1], circles[:, 0], circles[:, 2], -score))


def scores(circles: np.ndarray, edges: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """How well the gradient at edge pixels of each perimeter points along the radius: 1 for all of it, 0 for none, -1 for across."""
    out = np.zeros(len(circles))
    if not len(circles):
        return out
    pad = 2 * int(circles[:, 2].max())
    edges, angle = np.pad(edges, pad), np.pad(angle, pad)
    for r in np.unique(circles[:, 2]):
        at = np.flatnonzero(circles[:, 2] == r)
        p = ring(int(r))
        expected = np.arctan2(p[:, 0], p[:, 1])
        for lo in range(0, len(at), 20_000):
            some = at[lo : lo + 20_000]
            yy, xx = circles[some, 0][:, None] + p[:, 0] + pad, circles[some, 1][:, None] + p[:, 1] + pad
            off = np.abs(angle[yy, xx] - expected)
            off = np.where(off > np.pi, off - np.pi, off)
            out[some] = np.where(edges[yy, xx], 4 * np.abs(off - np.pi / 2) / np.pi - 1, 0).sum(axis=1) / len(p)
    return out


def greedy(circles: np.ndarray, min_dist: int, shape: tuple[int, int]) -> np.ndarray:
    """Indices of circles, best first as given, whose ring of radius min_dist touches no ring of one chosen before."""
    if min_dist <= 0:
        return np.arange(len(circles))
    pad = 2 * min_dist + 2 + int(circles[:, 2].max(initial=0))
    claimed = np.zeros((shape[0] + 2 * pad, shape[1] + 2 * pad), dtype=bool)
    p = ring(min_dist, True)
    chosen = []
    for i, (y, x, _) in enumerate(circles):
        yy, xx = p[:, 0] + y + pad, p[:, 1] + x + pad
        if not claimed[yy, xx].any():
            claimed[yy, xx] = True
            chosen.append(i)
    return np.array(chosen, dtype=np.int64)


def find_circles(
    image: np.ndarray, low_quantile: float, high_quantile: float, grid: int, n_iter: int, min_radius: int, max_radius: int, min_roundness: float, min_dist: int, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Circles (row, col, radius) as whole numbers and their scores, best first; the same input and seed give the same output."""
    nothing = np.zeros((0, 3), dtype=np.int64), np.zeros(0)
    if image.size == 0 or image.min() == image.max():
        return nothing
    dy, dx = gradients(smooth(image))
    edges = canny(np.rint(dy), np.rint(dx), *thresholds(dy, dx, low_quantile, high_quantile))
    found = distinct_candidates(edges, n_iter, grid, np.random.default_rng(seed), min_radius, max_radius, image.shape)
    if not len(found):
        return nothing
    s = scores(found, edges, np.arctan2(dy, dx))
    keep = s >= min_roundness
    found, s = found[keep], s[keep]
    order = rank(found, s)
    found, s = found[order], s[order]
    at = greedy(found, min_dist, image.shape)
    return found[at], s[at]
