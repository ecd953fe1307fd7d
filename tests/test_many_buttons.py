"""Buttons of chips that are too large for one task."""

import numpy as np
import pytest
from drawing import chip
from test_wide import blocks

from spotlake.model import Assay, table
from spotlake.operators import find, wide

KINDS = "assay string, mark int, time_idx int, y double, x double, tag string, radius double"


def assay(spark, rows, cols):
    tags = spark.createDataFrame([(i, j, "" if (i, j) == (1, 1) else "t") for i in range(rows) for j in range(cols)], "mark_row int, mark_col int, tag string")
    dims = table("dims", [("a", "channel", 0, "0", {}), ("a", "time", 0, "0", {})])
    return Assay({"image": blocks(spark, chip(rows, cols), 50, 70).persist(), "tags": tags, "dims": dims}, {"name": "a"})


def test_buttons_of_a_large_plane_have_small_plans(spark, monkeypatch):
    """Before, a plan had that of each kept table as often as it was used, and the driver's memory ran out."""
    monkeypatch.setattr(wide, "LARGE", 50_000)
    monkeypatch.setattr(wide, "SIDE", 100)
    monkeypatch.setattr(find, "plane", None)
    out = find.find_buttons(assay(spark, 3, 3), row_dist=100, col_dist=100, min_button_diameter=16, max_button_diameter=32, num_iter=20_000)
    assert len(out["marks"]._jdf.queryExecution().toString()) < 500_000
    marks = out["marks"].orderBy("mark").collect()
    assert [(round(m.y / 10), round(m.x / 10)) for m in marks] == [(10 * i, 10 * j) for i in (1, 2, 3) for j in (1, 2, 3)]
    assert all(m.radius == 16 if m.tag == "" else abs(m.radius - 10) <= 1 for m in marks)


@pytest.mark.parametrize("few", [0, 1000])
def test_regions_are_dealt_out(spark, monkeypatch, few):
    """Before, Spark put regions that pack well into one task, however many there were."""
    monkeypatch.setattr(find, "CHUNK", 2)
    monkeypatch.setattr(find, "REGIONS", 30**2, raising=False)
    monkeypatch.setattr(find, "FEW", few, raising=False)
    image = chip(4, 4)
    places = [(100 * (k // 4) + 95 + k, 100 * (k % 4) + 105 - k) for k in range(16)]
    marks = spark.createDataFrame([("a", k, 0, float(y), float(x), "t", 10.0) for k, (y, x) in enumerate(places)], KINDS)
    rois = find.cut_rois(blocks(spark, image, 50, 70), marks, 30, *image.shape)
    assert rois.rdd.getNumPartitions() == 16
    got = rois.collect()
    assert sorted(r.mark for r in got) == list(range(16))
    for r in got:
        assert (np.reshape(r.px, (30, 30)) == image[r.top : r.top + 30, r.left : r.left + 30]).all() and (r.top, r.left) == tuple(v - 15 for v in places[r.mark])


def test_buttons_are_found_however_many_share_the_draws(spark):
    """Before, each of many buttons had so few draws that it kept the place of the grid and the largest radius."""
    image, n = chip(1, 1), 300
    px = image[65:137, 65:137].astype(float).ravel().tolist()
    rois = spark.createDataFrame([("a", k, "0", 0, 65, 65, 72, px) for k in range(n)], find.SCHEMAS["roi"])
    marks = spark.createDataFrame([("a", k, 0, 103.0, 98.0, "t", None) for k in range(n)], KINDS)
    found = find.refine(rois, marks, 8, 16, 0.1, 1, 0.2).collect()
    assert len(found) == n and all(abs(m.y - 100) <= 1 and abs(m.x - 100) <= 1 and abs(m.radius - 10) <= 1 for m in found)
