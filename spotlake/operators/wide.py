"""Circles of planes too large for one task: the steps of the detector in windows that exchange what lies near their borders.

Edges, thresholds and the greedy choice are exactly those of the whole plane; only the random candidates are other ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, GroupedData, Row, Window
from pyspark.sql import functions as F

from spotlake.operators.circles import distinct_candidates, flood, gradients, maxima, rank, scores, smooth
from spotlake.operators.geometry import ring
from spotlake.session import settled

#: Pixels a plane may have to be searched by one task, and about the side of a window where it has more.
LARGE, SIDE = 1 << 22, 1000
#: Candidates for each edge pixel of a plane in windows, where that is more than is asked for: as planes grow, circles are not missed.
DRAWS = 8
#: How far away a pixel can matter for whether a pixel is a maximum: smoothing 2, gradient 1, its neighbour 1.
NEAR = 4
KEYS = ["assay", "channel", "time_idx"]
AT = [*KEYS, "wy", "wx"]
_KEY = "assay string, channel string, time_idx int, wy int, wx int"
_PEAKS = f"{_KEY}, h int, w int, bad boolean, y array<int>, x array<int>, dy array<int>, dx array<int>, size array<double>, n array<long>"
_EDGES = f"{_KEY}, own boolean, h int, w int, y array<int>, x array<int>, dy array<int>, dx array<int>, got array<boolean>, fresh array<boolean>"
_FOUND = f"{_KEY}, y int, x int, radius int, score double"
_CHOICE = f"{_KEY}, own boolean, y array<int>, x array<int>, radius array<int>, score array<double>, chosen array<boolean>"


def extents(image: DataFrame) -> DataFrame:
    """Of each plane its size, how many pixels are in blocks, and the least and largest of them."""
    area = F.sum(F.col("height").cast("long") * F.col("width"))
    ends = F.max(F.col("y0") + F.col("height")).alias("h"), F.max(F.col("x0") + F.col("width")).alias("w")
    return image.groupBy(*KEYS).agg(*ends, area.alias("area"), F.min(F.array_min("px")).alias("lo"), F.max(F.array_max("px")).alias("hi"))


def is_large(plane: Row) -> bool:
    return plane.h * plane.w > LARGE


def _frame(schema: str, rows: Sequence[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=[f.split()[0] for f in schema.split(", ")])


def _kept(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)


def _dealt(df: DataFrame, windows: int) -> GroupedData:
    """By window, a few windows a task: these rows are so small when packed that Spark would put all of them into one task."""
    return df.repartition(math.ceil(windows / 4), *AT).groupBy(*AT)


def _windows(y0: int, y1: int, size: int, side: int) -> range:
    return range(max(y0, 0) // side, (min(y1, size) - 1) // side + 1)


def _neighbours(key: tuple, y: np.ndarray, x: np.ndarray, reach: int, side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Other windows, and which of the points are less than reach + 1 from each."""
    k = math.ceil(reach / side)
    for wy in range(key[3] - k, key[3] + k + 1):
        for wx in range(key[4] - k, key[4] + k + 1):
            if (wy, wx) != tuple(key[3:5]) and wy >= 0 and wx >= 0:
                near = (y >= wy * side - reach) & (y < (wy + 1) * side + reach) & (x >= wx * side - reach) & (x < (wx + 1) * side + reach)
                if near.any():
                    yield wy, wx, near


def peaks(image: DataFrame, planes: DataFrame, side: int, windows: int) -> DataFrame:
    """A row for each window: the maxima of the gradient across it, and how often each length of it other than 0 occurs."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                px = np.asarray(r.px, dtype=np.float64).reshape(r.height, r.width)
                bad = bool(np.isnan(px).any())
                u = np.zeros(px.shape, dtype=np.uint8) if bad else (255 * (px - r.lo) / (r.hi - r.lo)).astype(np.uint8)
                for wy in _windows(r.y0 - NEAR, r.y0 + r.height + NEAR, r.h, side):
                    for wx in _windows(r.x0 - NEAR, r.x0 + r.width + NEAR, r.w, side):
                        y1, x1 = max(wy * side - NEAR, r.y0), max(wx * side - NEAR, r.x0)
                        y2, x2 = min((wy + 1) * side + NEAR, r.y0 + r.height), min((wx + 1) * side + NEAR, r.x0 + r.width)
                        rows.append((r.assay, r.channel, r.time_idx, wy, wx, r.h, r.w, r.lo, r.hi, bad, y1, x1, y2, x2, u[y1 - r.y0 : y2 - r.y0, x1 - r.x0 : x2 - r.x0].tobytes()))
            yield _frame(pieces, rows)

    def put(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, wy, wx = pdf.iloc[0], int(key[3]), int(key[4])
        h, w = int(r["h"]), int(r["w"])
        top, left = max(wy * side - NEAR, 0), max(wx * side - NEAR, 0)
        empty = np.uint8(255 * (0 - r["lo"]) / (r["hi"] - r["lo"])) if r["lo"] <= 0 <= r["hi"] else 0
        out = np.full((min((wy + 1) * side + NEAR, h) - top, min((wx + 1) * side + NEAR, w) - left), empty, dtype=np.uint8)
        for y1, x1, y2, x2, px in zip(pdf["y1"], pdf["x1"], pdf["y2"], pdf["x2"], pdf["px"]):
            out[y1 - top : y2 - top, x1 - left : x2 - left] = np.frombuffer(px, dtype=np.uint8).reshape(y2 - y1, x2 - x1)
        dy, dx = gradients(smooth(out))
        size, peak = maxima(dy, dx)
        own = (slice(wy * side - top, (wy + 1) * side - top), slice(wx * side - left, (wx + 1) * side - left))
        length, n = np.unique(size[own][size[own] > 0], return_counts=True)
        y, x = np.nonzero(peak[own] & (size[own] > 0))
        row = (*key, h, w, bool(pdf["bad"].any()), y + wy * side, x + wx * side, dy[own][y, x].astype(int), dx[own][y, x].astype(int), length, n)
        return _frame(_PEAKS, [row])

    pieces = f"{_KEY}, h int, w int, lo double, hi double, bad boolean, y1 int, x1 int, y2 int, x2 int, px binary"
    return _dealt(image.join(F.broadcast(planes), KEYS).mapInPandas(cut, pieces), windows).applyInPandas(put, _PEAKS)


def thresholds(found: DataFrame, planes: Sequence[Row], quantiles: Sequence[float]) -> list[tuple]:
    """(KEYS, low, high): quantiles, interpolated, of the lengths of the gradient at all pixels of a plane, as numpy has them."""
    lengths = found.select(*KEYS, F.inline(F.arrays_zip("size", "n"))).groupBy(*KEYS, "size").agg(F.sum("n").alias("n"))
    known = {tuple(r[:3]): r for r in found.groupBy(*KEYS).agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v)).alias("n"), F.max("bad").alias("bad")).collect()}
    wanted, places = [], {}
    for p in planes:
        key, total = tuple(p[k] for k in KEYS), p.h * p.w
        if key not in known or known[key].bad:
            continue
        at = (total - 1) * np.asarray(quantiles, dtype=np.float64)
        low = np.floor(at).astype(np.int64)
        flat = total - known[key].n
        places[key] = at - low, [(int(a) - flat, min(int(a) + 1, total - 1) - flat) for a in low]
        wanted += [(*key, r) for pair in places[key][1] for r in pair if r >= 0]
    got: dict[tuple, float] = {}
    if wanted:
        upto = F.sum("n").over(Window.partitionBy(*KEYS).orderBy("size"))
        ranks = found.sparkSession.createDataFrame(sorted(set(wanted)), "assay string, channel string, time_idx int, rank long")
        met = lengths.withColumn("upto", upto).join(F.broadcast(ranks), KEYS).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        got = {tuple(r[:4]): r[4] for r in met.select(*KEYS, "rank", "size").collect()}
    rows = []
    for key, (part, pairs) in places.items():
        ends = [(got.get((*key, a), 0.0), got.get((*key, b), 0.0)) for a, b in pairs]
        rows.append((*key, *[float(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)) for (a, b), t in zip(ends, part)]))
    return rows


def edges(found: DataFrame, limits: Sequence[tuple], side: int, windows: int) -> DataFrame:
    """A row for each window: its edge pixels and the gradient there. Edges go on over borders until no window reaches any more of the next."""

    def masks(r, wy: int, wx: int) -> tuple[np.ndarray, ...]:
        y, x = np.asarray(r.y) - wy * side + 1, np.asarray(r.x) - wx * side + 1
        weak = np.zeros((side + 2, side + 2), dtype=bool)
        weak[y, x] = True
        return y, x, weak

    def start(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                size = np.hypot(np.asarray(r.dy, dtype=np.float64), np.asarray(r.dx, dtype=np.float64))
                at = size > r.low
                some = r._replace(**{c: np.asarray(getattr(r, c))[at] for c in ("y", "x", "dy", "dx")})
                y, x, weak = masks(some, r.wy, r.wx)
                strong = np.zeros_like(weak)
                strong[y, x] = size[at] > r.high
                got = flood(strong, weak)[y, x]
                rows.append((*r[:5], True, r.h, r.w, some.y, some.x, some.dy, some.dx, got, got))
            yield _frame(_EDGES, rows)

    def send(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rows.append(tuple(r))
                new = np.asarray(r.fresh, dtype=bool)
                y, x = np.asarray(r.y)[new], np.asarray(r.x)[new]
                rows += [(*r[:3], wy, wx, False, r.h, r.w, y[near], x[near], [], [], [], []) for wy, wx, near in _neighbours(r, y, x, 1, side)]
            yield _frame(_EDGES, rows)

    def go_on(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = next(pdf[pdf["own"]].itertuples(index=False), None)
        if own is None:
            return _frame(_EDGES, [])
        y, x, weak = masks(own, own.wy, own.wx)
        got, seeds = np.asarray(own.got, dtype=bool), np.zeros_like(weak)
        weak[y[got], x[got]] = False
        for ys, xs in zip(pdf["y"][~pdf["own"]], pdf["x"][~pdf["own"]]):
            seeds[np.asarray(ys) - own.wy * side + 1, np.asarray(xs) - own.wx * side + 1] = True
        fresh = flood(seeds, weak)[y, x] & ~got
        return _frame(_EDGES, [own._replace(got=got | fresh, fresh=fresh)])

    rows = found.sparkSession.createDataFrame(limits, "assay string, channel string, time_idx int, low double, high double")
    now = _kept(found.join(F.broadcast(rows), KEYS).mapInPandas(start, _EDGES))
    # where nothing waits beside a border, nothing has to be sent
    waits = F.exists(F.arrays_zip("y", "x", "got"), lambda p: ~p["got"] & ((p["y"] % side).isin(0, side - 1) | (p["x"] % side).isin(0, side - 1)))
    while now.filter(F.exists("fresh", lambda v: v)).limit(1).count() and now.filter(waits).limit(1).count():
        before, now = now, _kept(_dealt(now.mapInPandas(send, _EDGES), windows).applyInPandas(go_on, _EDGES))
        now.count()
        before.unpersist()
    return now


def search(found: DataFrame, side: int, windows: int, grid: int, n_iter: int, min_radius: int, max_radius: int, min_roundness: float, seed: int) -> DataFrame:
    """Circles through edge pixels, at least as round as is asked for, in the window where their middle is."""
    reach = 2 * max_radius + 2
    pad = grid * math.ceil(reach / grid)

    def send(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                got = np.asarray(r.got, dtype=bool)
                y, x, dy, dx = (np.asarray(c)[got] for c in (r.y, r.x, r.dy, r.dx))
                rows.append((*r[:5], True, r.h, r.w, y, x, dy, dx, [], []))
                rows += [(*r[:3], wy, wx, False, r.h, r.w, y[near], x[near], dy[near], dx[near], [], []) for wy, wx, near in _neighbours(r, y, x, reach, side)]
            yield _frame(_EDGES, rows)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = next(pdf[pdf["own"]].itertuples(index=False), None)
        if own is None or not len(own.y):
            return _frame(_FOUND, [])
        wy, wx = int(key[3]), int(key[4])
        y, x, dy, dx = (np.concatenate([np.asarray(v) for v in pdf[c]]) for c in ("y", "x", "dy", "dx"))
        edge, angle = np.zeros((side + 2 * pad, side + 2 * pad), dtype=bool), np.zeros((side + 2 * pad, side + 2 * pad))
        y, x = y - wy * side + pad, x - wx * side + pad
        edge[y, x], angle[y, x] = True, np.arctan2(dy.astype(np.float64), dx.astype(np.float64))
        total = totals[tuple(key[:3])]
        n = math.ceil(max(n_iter, DRAWS * total) * len(own.y) / total)
        rng = np.random.default_rng([seed, wy, wx])
        c = distinct_candidates(edge[pad : pad + side, pad : pad + side], n, grid, rng, min_radius, max_radius, (own.h, own.w), (wy * side, wx * side))
        s = scores(c + [pad - wy * side, pad - wx * side, 0], edge, angle)
        c, s = c[s >= min_roundness], s[s >= min_roundness]
        out = pd.DataFrame({k: key[i] for i, k in enumerate(KEYS)}, index=range(len(c)))
        at = (np.clip(c[:, i] // side, 0, (n - 1) // side) for i, n in enumerate((own.h, own.w)))
        return out.assign(**dict(zip(("wy", "wx"), at)), y=c[:, 0], x=c[:, 1], radius=c[:, 2], score=s)

    counts = found.groupBy(*KEYS).agg(F.sum(F.size(F.filter("got", lambda v: v))).alias("n")).filter("n > 0").collect()
    totals = {tuple(r[:3]): int(r[3]) for r in counts}  # large planes are few
    return _dealt(found.mapInPandas(send, _EDGES), windows).applyInPandas(run, _FOUND)


def choose(found: DataFrame, side: int, windows: int, min_dist: int, max_radius: int) -> DataFrame:
    """The greedy choice of circles by rank: those are settled of which no better one that they meet is open, until none is."""
    reach, p = 2 * min_dist + 2 + max_radius, ring(max(min_dist, 0), True)

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["y", "x", "radius"])
        return _frame(_CHOICE, [(*key, True, *[pdf[c].to_numpy() for c in ("y", "x", "radius", "score")], np.zeros(len(pdf), dtype=bool))])

    def send(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rows.append(tuple(r))
                own = [np.asarray(c) for c in r[6:]]
                rows += [(*r[:3], wy, wx, False, *[c[near] for c in own]) for wy, wx, near in _neighbours(r, own[0], own[1], reach, side)]
            yield _frame(_CHOICE, rows)

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():
            return _frame(_CHOICE, [])
        y, x, r, s, chosen = (np.concatenate([np.asarray(v) for v in pdf[c]]) for c in ("y", "x", "radius", "score", "chosen"))
        chosen, keep = chosen.astype(bool), np.ones(len(y), dtype=bool)
        own = np.repeat(pdf["own"].to_numpy(dtype=bool), [len(v) for v in pdf["y"]])
        top, left = y.min() - min_dist - 1, x.min() - min_dist - 1
        taken = np.zeros((y.max() - top + min_dist + 2, x.max() - left + min_dist + 2), dtype=np.uint8)  # 1: by one that is open, 2: by one that is chosen
        for i in rank(np.column_stack([y, x, r]), s):
            yy, xx = p[:, 0] + (y[i] - top), p[:, 1] + (x[i] - left)
            most = 0 if chosen[i] else taken[yy, xx].max()
            if most == 2:
                keep[i] = False
                continue
            chosen[i] = chosen[i] or (own[i] and most == 0)
            taken[yy, xx] = 2 if chosen[i] else np.maximum(taken[yy, xx], 1)
        at = own & keep
        return _frame(_CHOICE, [(*key, True, y[at], x[at], r[at], s[at], chosen[at])])

    now = _kept(_dealt(found, windows).applyInPandas(gather, _CHOICE))
    is_open = F.exists("chosen", lambda v: ~v)
    while min_dist > 0 and now.filter(is_open).limit(1).count():
        before, now = now, _kept(_dealt(now.mapInPandas(send, _CHOICE), windows).applyInPandas(settle, _CHOICE))
        now.count()
        before.unpersist()
    out = settled(now.select(*KEYS, F.inline(F.arrays_zip("y", "x", "radius", "score"))).coalesce(math.ceil(windows / 64)))
    now.unpersist()
    return out


def detect(
    image: DataFrame, planes: Sequence[Row], low_quantile: float, high_quantile: float, grid: int, n_iter: int, min_radius: int, max_radius: int, min_roundness: float, min_dist: int, seed: int = 0
) -> DataFrame:
    """Circles of the planes, which are rows of extents(image), in windows whose side is a multiple of the grid's."""
    side = grid * math.ceil(SIDE / grid)
    known = []
    for p in planes:
        lo, hi = ((min(p.lo, 0.0), max(p.hi, 0.0)) if p.area < p.h * p.w and p.lo is not None else (p.lo, p.hi))  # pixels in no block are 0
        if lo is not None and lo < hi and math.isfinite(lo) and math.isfinite(hi):
            known.append((*[p[k] for k in KEYS], p.h, p.w, lo, hi))
    rows = image.sparkSession.createDataFrame(known, "assay string, channel string, time_idx int, h int, w int, lo double, hi double")
    windows = max(1, sum(math.ceil(p.h / side) * math.ceil(p.w / side) for p in planes))
    maximal = _kept(peaks(image, rows, side, windows))
    border = edges(maximal, thresholds(maximal, planes, (low_quantile, high_quantile)), side, windows)
    found = choose(search(border, side, windows, grid, n_iter, min_radius, max_radius, min_roundness, seed), side, windows, min_dist, max_radius)
    maximal.unpersist()
    border.unpersist()
    return found
