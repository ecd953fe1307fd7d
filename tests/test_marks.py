import numpy as np
import pandas as pd
import pytest
from drawing import beads, chip

import spotlake as sl
from spotlake.model import from_numpy
from spotlake.operators import filters, identify
from spotlake.operators.circles import find_circles, to_uint8
from spotlake.operators.finish import to_numpy
from spotlake.operators.geometry import disk, disk_mask, ring, window


def test_disks_and_rings():
    assert [len(disk(r)) for r in (1, 2, 3, 4, 5, 7, 8, 10, 12, 14, 16, 20, 25)] == [9, 21, 37, 61, 93, 169, 217, 341, 473, 649, 837, 1305, 2021]
    for r in range(1, 80):
        assert len(np.unique(ring(r), axis=0)) == len(ring(r))
    assert window(0, 99, 10, 100, 100) == (0, 90)
    with pytest.raises(ValueError):
        window(5, 5, 200, 100, 100)


def circles_of(image, low=8, high=12, n=10_000, roundness=0.3):
    return find_circles(to_uint8(image), 0.1, 0.9, 20, n, low, high, roundness, low)[0]


CASES = {
    "single": [(512, 512)], "five": [(200, 200), (200, 800), (512, 512), (800, 200), (800, 800)], "edges": [(50, 512), (974, 512), (512, 50), (512, 974)], "close": [(500, 500), (500, 540), (540, 500)],
}


@pytest.mark.parametrize("case", CASES)
def test_detector(case):
    found = circles_of(beads(1024, CASES[case]))
    assert sorted(map(tuple, found[:, :2])) == sorted(CASES[case])
    assert (abs(found[:, 2] - 10) <= 1).all()


def test_detector_sizes_and_intensities():
    found = circles_of(beads(1024, CASES["edges"], [16, 20, 24, 28]), 7, 16)
    assert len(found) == 4 and (found[:, 2].max() / found[:, 2].min()) ** 2 > 1.5
    assert len(circles_of(beads(1024, CASES["close"], values=[500, 1000, 2000]))) == 3
    assert len(circles_of(np.zeros((512, 512)))) == 0
    assert np.array_equal(circles_of(beads(300, [(90, 99)])), circles_of(beads(300, [(90, 99)]).astype(np.float32)))


OPTIONS = dict(min_bead_diameter=16, max_bead_diameter=24, overlap=0, num_iter=5000)


def test_beads_in_channels(spark):
    both = np.stack([beads(256, [(60, 60), (60, 190)]), beads(256, [(60, 60), (190, 120)], values=2000)])
    assay = from_numpy(both, ("channel", "y", "x"), {"channel": ["red", "green"]})
    out = sl.beads(assay, **OPTIONS)
    m = out["marks"].orderBy("mark").toPandas()
    assert sorted(zip(m.y, m.x)) == [(60, 60), (60, 190), (190, 120)] and m.valid.all()
    assert to_numpy(out, "roi").shape == (3, 2, 48, 48)
    fg = out["masks"].orderBy("mark").toPandas()["fg"]
    assert all(abs(np.sqrt(sum(f) / np.pi) - 10) < 1 for f in fg)
    red = sl.beads(assay, search_channel="red", **OPTIONS)["marks"].count()
    assert red == 2


def test_no_beads(spark):
    out = sl.beads(np.zeros((128, 128), np.uint16), **OPTIONS)
    assert out["marks"].count() == 0 and out["roi"].count() == 0 and out["masks"].count() == 0
    with pytest.raises(ValueError):
        sl.beads(np.zeros((128, 128)), min_bead_diameter=9, max_bead_diameter=5)
    with pytest.raises(NotImplementedError):
        sl.beads(np.zeros((128, 128)), interactive=True)


CHIP = dict(min_button_diameter=16, max_button_diameter=32, overlap=0, row_dist=100, col_dist=100, num_iter=5000)


def test_chip_times(spark):
    frames = np.stack([chip(2, 3), chip(2, 3, shift=10), chip(2, 3)])
    out = sl.microfluidic_chip(from_numpy(frames, ("time", "y", "x")), shape=(2, 3), search_timestep=[0, 1], **CHIP)
    m = out["marks"].toPandas().pivot(index="mark", columns="time_idx", values=["y", "x"])
    for r in range(2):
        for c in range(3):
            at = m.loc[r * 3 + c]
            assert abs(at["y", 0] - 100 * (r + 1)) <= 2 and abs(at["x", 0] - 100 * (c + 1)) <= 2
            assert abs(at["y", 1] - 100 * (r + 1) - 10) <= 2
            assert at["y", 2] == at["y", 1] and at["x", 2] == at["x", 1]
    assert to_numpy(out, "roi").shape == (6, 3, 72, 72)


def test_chip_blanks(spark):
    out = sl.microfluidic_chip(chip(3, 3, blanks=[(0, 0), (1, 2)]), shape=(3, 3), **CHIP)
    m = out["marks"].toPandas()
    assert len(m) == 9
    found = m[m.score.notna()]
    assert len(found) == 7 and (abs(found.radius - 10) <= 1).all()


def coded(n=40, seed=3):
    rng = np.random.default_rng(seed)
    codes = np.array([[i, j] for i in (0.2, 0.6) for j in (0.3, 0.9)])
    own = np.repeat(np.arange(4), n)
    x = 1.1 * codes[own] + 0.05 + rng.normal(0, 0.01, (4 * n, 2))
    outliers = rng.uniform(0, 1.2, (8, 2))
    return np.vstack([x, outliers]), codes, own


def test_codes_are_assigned():
    x, codes, own = coded()
    tags = identify.assign_codes(x, codes, ["a", "b", "c", "d"])
    assert np.mean([t == "abcd"[o] for t, o in zip(tags, own)]) > 0.95
    assert identify.assign_codes(np.zeros((0, 2)), codes, list("abcd")) == []
    some = identify.assign_codes(np.vstack([x[:40], [[np.nan, 1]]]), codes, list("abcd"))
    assert some[-1] == identify.OUTLIER


def test_unmixing_is_least_squares(spark):
    rng = np.random.default_rng(0)
    spectra = pd.DataFrame(rng.random((3, 5)), index=["eu", "dy", "sm"], columns=list("vwxyz"))
    volumes = rng.random((6, 3)) + 0.5
    mixed = volumes @ spectra.to_numpy()
    rows = [("a", m, c, float(mixed[m, j])) for m in range(6) for j, c in enumerate("vwxyz")]
    got = identify.unmix(spark.createDataFrame(rows, "assay string, mark int, channel string, i double"), spectra, "eu").toPandas().pivot(index="mark", columns="ln", values="vol")
    assert np.allclose(got[["eu", "dy", "sm"]].to_numpy(), volumes)


def test_roundness():
    assert filters.roundness(disk_mask(64, (32, 32), 12)) > 0.75
    bar = np.zeros((64, 64), bool)
    bar[30:33, 5:60] = True
    assert filters.roundness(bar) < 0.4
    square = np.zeros((64, 64), bool)
    square[20:31, 20:31] = True
    assert filters.outer_length(square) == pytest.approx(40)
    one = np.zeros((9, 9), bool)
    assert filters.roundness(one) is None
    one[4, 4] = True
    assert filters.roundness(one) is None


def test_filters_turn_off_only(spark):
    out = sl.beads(beads(256, [(60, 60), (60, 190), (190, 120)], values=[1000, 900, 40]) + np.random.default_rng(0).integers(0, 9, (256, 256)).astype(np.uint16), **OPTIONS)
    strong = filters.filter_expression(out, min_contrast=500)["marks"].toPandas()
    assert set(zip(strong.y, strong.valid)) >= {(60.0, True)} and not strong[strong.y > 150].valid.any()
    clean = sl.beads(beads(256, [(60, 60), (60, 190)]), **OPTIONS)
    assert filters.filter_nonround(clean)["marks"].filter("valid").count() == 2
    assert filters.filter_nonround(clean, min_roundness=0.99)["marks"].filter("valid").count() == 0


def test_leaks(spark):
    med = [("a", m, "0", 10.0 + 500 * (m in (1, 2)), 10.0 + 0.1 * m) for m in range(6)]
    tags = ["x", "", "x", "", "x", "x"]
    marks = [("a", m, m // 3, m % 3, tags[m]) for m in range(6)]
    got = filters.leak_free(spark.createDataFrame(med, "assay string, mark int, channel string, fg double, bg double"), spark.createDataFrame(marks, "assay string, mark int, mark_row int, mark_col int, tag string"))
    # in the first row only the place after, in the last only the one before is looked at
    assert {r.mark: r.fine for r in got.collect()} == {0: False, 1: True, 2: True, 3: True, 4: True, 5: True}


def test_one_button_and_one_row(spark):
    m = sl.microfluidic_chip(chip(1, 1), shape=(1, 1), **CHIP)["marks"].toPandas()
    assert len(m) == 1 and abs(m.x[0] - 100) <= 5 and abs(m.y[0] - 100) <= 5 and abs(m.radius[0] - 10) <= 1
    m = sl.microfluidic_chip(chip(1, 3).astype(np.float32), shape=(1, 3), **CHIP)["marks"].orderBy("mark").toPandas()
    assert [round(v / 100) for v in m.x] == [1, 2, 3]


def test_known_first_chamber(spark):
    m = sl.microfluidic_chip(chip(2, 2), shape=(2, 2), top_chamber=70, left_chamber=70, **CHIP)["marks"].orderBy("mark").toPandas()
    assert [(round(y), round(x)) for y, x in zip(m.y, m.x)] == [(100, 100), (100, 200), (200, 100), (200, 200)]


def test_coded_beads_from_end_to_end(spark, tmp_path):
    spectra = pd.DataFrame([[1.0, 0.2, 0.1, 0.0], [0.1, 1.0, 0.3, 0.1], [0.0, 0.2, 1.0, 0.4]], index=["eu", "dy", "sm"], columns=list("abcd"))
    codes = pd.DataFrame([[1.0, 0.2, 0.3], [1.0, 0.2, 0.9], [1.0, 0.8, 0.3], [1.0, 0.8, 0.9]], index=["k0", "k1", "k2", "k3"], columns=["eu", "dy", "sm"])
    spectra.rename_axis("name").to_csv(tmp_path / "spectra.csv")
    codes.rename_axis("name").to_csv(tmp_path / "codes.csv")
    rng = np.random.default_rng(0)
    places = [(40 + 50 * i, 40 + 50 * j) for i in range(8) for j in range(8)]
    own = rng.integers(0, 4, len(places))
    volumes = codes.to_numpy()[own] * 2000 * (1 + rng.normal(0, 0.01, (len(places), 3)))
    mixed = volumes @ spectra.to_numpy()
    image = np.stack([beads(440, places, values=[int(v) for v in mixed[:, c]]) + rng.integers(0, 3, (440, 440)).astype(np.uint16) for c in range(4)])
    out = sl.mrbles(
        from_numpy(image, ("channel", "y", "x"), {"channel": list("abcd")}), str(tmp_path / "spectra.csv"), str(tmp_path / "codes.csv"), min_bead_diameter=16, max_bead_diameter=24, overlap=0,
        num_iter=60_000, search_channel="a", reference="eu",
    )
    m = out["marks"].toPandas()
    want = {p: f"k{k}" for p, k in zip(places, own)}
    near = {(y, x): t for y, x, t in zip(m.y, m.x, m.tag) if (y, x) in want}
    assert len(near) >= 60 and np.mean([near[p] == want[p] for p in near]) > 0.85
    assert out["ln"].count() == 3 * len(m)
    with pytest.raises(ValueError):
        sl.mrbles(image, spectra, codes, reference="tm", overlap=0, min_bead_diameter=16, max_bead_diameter=24, num_iter=100)
