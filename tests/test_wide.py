"""Planes searched in windows give what they give as a whole."""

import numpy as np
import pytest
from drawing import beads
from pyspark.sql import functions as F

from spotlake.model import SCHEMAS
from spotlake.operators import find, wide
from spotlake.operators.circles import canny, gradients, greedy, rank, smooth, thresholds, to_uint8


def blocks(spark, image, height, width, without=()):
    rows = [
        ("a", "0", 0, y, x, *image[y : y + height, x : x + width].shape, image[y : y + height, x : x + width].astype(float).ravel().tolist())
        for y in range(0, image.shape[0], height) for x in range(0, image.shape[1], width) if (y, x) not in without
    ]
    return spark.createDataFrame(rows, SCHEMAS["image"])


@pytest.mark.parametrize("quantiles", [(0.1, 0.9), (0.5, 0.995), (0.3, 0.6)])
def test_edges_in_windows_are_those_of_the_plane(spark, quantiles):
    rng = np.random.default_rng(3)
    image = smooth(rng.integers(0, 5000, (131, 97))) - 400
    image[30:70, 40:80] = 0  # in no block
    df = blocks(spark, image, 10, 40, [(y, 40) for y in range(30, 70, 10)])
    planes = wide.extents(df).collect()
    p = planes[0]
    limits = spark.createDataFrame([("a", "0", 0, p.h, p.w, min(p.lo, 0.0), max(p.hi, 0.0))], "assay string, channel string, time_idx int, h int, w int, lo double, hi double")
    found = wide.peaks(df, limits, 40, 12)
    ends = wide.thresholds(found, planes, quantiles)
    dy, dx = gradients(smooth(to_uint8(image)))
    assert ends == [("a", "0", 0, *thresholds(dy, dx, *quantiles))]
    got = wide.edges(found, ends, 40, 12).select(F.inline(F.arrays_zip("y", "x", "got"))).filter("got").collect()
    assert sorted((r.y, r.x) for r in got) == [tuple(p) for p in np.argwhere(canny(dy, dx, *ends[0][3:]))]


def test_choice_in_windows_is_that_of_the_plane(spark):
    rng = np.random.default_rng(4)
    c = np.unique(np.column_stack([rng.integers(-5, 205, 3000), rng.integers(-5, 155, 3000), rng.integers(5, 9, 3000)]), axis=0)
    s = np.round(rng.random(len(c)), 2)
    rows = [("a", "0", 0, *(int(np.clip(v // 40, 0, n)) for v, n in zip(r[:2], (4, 3))), *map(int, r), float(v)) for r, v in zip(c, s)]
    df = spark.createDataFrame(rows + rows[:50], wide._FOUND)
    got = wide.choose(df, 40, 20, 6, 8).collect()
    order = rank(c, s)
    assert sorted((r.y, r.x, r.radius) for r in got) == sorted(map(tuple, c[order][greedy(c[order], 6, (200, 150))].tolist()))


def test_detection_of_a_large_plane_puts_it_together_nowhere(spark, monkeypatch):
    places = [(60 + 45 * i, 40 + 50 * j) for i in range(8) for j in range(4)]
    image = beads(460, places)[:, :260]
    options = dict(low_quantile=0.1, high_quantile=0.9, grid=20, n_iter=20_000, min_radius=8, max_radius=12, min_roundness=0.3, min_dist=8)
    df = blocks(spark, image, 50, 70)
    whole = {(r.y, r.x, r.radius) for r in find.detect(df, **options).collect()}
    assert {w[:2] for w in whole} == set(places)
    monkeypatch.setattr(wide, "LARGE", 50_000)
    monkeypatch.setattr(wide, "SIDE", 90)
    monkeypatch.setattr(find, "plane", None)
    found = find.detect(df, **options).collect()
    assert {(r.y, r.x) for r in found} == set(places) and len(found) == len(places)
    assert all(abs(r.radius - 10) <= 1 for r in found)
