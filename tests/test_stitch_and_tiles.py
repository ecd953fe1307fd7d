import numpy as np
import pytest

import spotlake as sl
from spotlake.model import Assay, from_numpy
from spotlake.operators import preprocess
from spotlake.operators.finish import to_numpy
from spotlake.operators.geometry import disk_mask
from spotlake.pipeline import COMPONENTS

DIMS = ("channel", "time", "row", "col", "y", "x")


def cube(*shape, seed=0):
    return np.random.default_rng(seed).random(shape)


def stitched(a, overlap, **more):
    return to_numpy(sl.image(from_numpy(a, DIMS, **more), overlap=overlap), "image")


def laid_out(a, overlap):
    """Every pixel of the image looked up on its own: the kept pixels of tiles, one tile after the other, from lead on."""
    n_c, n_t, rows, cols, h, w = a.shape
    lead, step_y, step_x = overlap // 2, h - overlap, w - overlap
    out = np.empty((n_c, n_t, rows * step_y, cols * step_x))
    for y in range(out.shape[2]):
        for x in range(out.shape[3]):
            out[:, :, y, x] = a[:, :, y // step_y, x // step_x, lead + y % step_y, lead + x % step_x]
    return out


@pytest.mark.parametrize(("shape", "overlap"), [((1, 1, 3, 1, 11, 17), 3), ((2, 1, 1, 4, 9, 6), 4), ((1, 2, 2, 2, 8, 13), 7), ((3, 2, 1, 1, 7, 5), 0), ((1, 1, 1, 1, 6, 12), 1)])
def test_against_a_lookup_by_pixel(spark, shape, overlap):
    a = cube(*shape, seed=sum(shape))
    want = laid_out(a, overlap)
    assert np.array_equal(stitched(a, overlap).reshape(want.shape), want)


def test_names_of_channels_and_times_stay(spark):
    out = sl.image(from_numpy(cube(2, 3, 1, 2, 9, 7), DIMS, coords={"channel": ["dapi", "cy5"], "time": [40, 50, 60]}), overlap=2)
    assert [(r.dim, r.label) for r in out["dims"].orderBy("dim", "idx").collect()] == [("channel", "dapi"), ("channel", "cy5"), ("time", "40"), ("time", "50"), ("time", "60")]
    assert "tiles" not in out


def test_guards(spark):
    stitch = COMPONENTS["stitch"]
    with pytest.raises(ValueError):
        stitch(overlap=-5)(from_numpy(cube(1, 1, 1, 1, 9, 9), DIMS))
    with pytest.raises(AttributeError):
        stitch(overlap=10)(Assay())
    with pytest.raises(ValueError):
        stitch(overlap=100)(from_numpy(cube(1, 1, 2, 2, 50, 50), DIMS))


def tile_of(assay):
    r = assay["tiles"].first()
    return np.asarray(r["px"]).reshape(r["height"], r["width"])


def test_unknown_dimensions_go_into_time(spark):
    a = from_numpy(cube(2, 3, 6, 6), ("plate", "time", "y", "x"))
    assert sorted(r[0] for r in a["tiles"].select("time_idx").collect()) == list(range(6))
    with pytest.raises(ValueError):
        from_numpy(cube(3), ("x",))


def test_flips(spark):
    a = cube(8, 9)
    assay = from_numpy(a, ("y", "x"))
    assert np.array_equal(tile_of(preprocess.horizontal_flip(assay)), a[:, ::-1])
    assert np.array_equal(tile_of(preprocess.vertical_flip(assay)), a[::-1])
    two = from_numpy(cube(1, 1, 2, 2, 10, 12), DIMS)
    image = sl.image(two, overlap=2)
    whole = to_numpy(image, "image").reshape(16, 20)
    assert np.array_equal(to_numpy(preprocess.horizontal_flip(image), "image").reshape(16, 20), whole[:, ::-1])
    assert np.array_equal(to_numpy(preprocess.vertical_flip(image), "image").reshape(16, 20), whole[::-1])


def test_flatfield(spark):
    a = (cube(12, 10) * 1000).astype(np.uint16)
    flat = 1 + cube(12, 10, seed=1)
    t = np.maximum(a - 5.0, 0)
    want = np.floor(t / flat * t.max() / (t / flat).max())
    got = tile_of(preprocess.flatfield_correct(from_numpy(a, ("y", "x")), flat, 5.0))
    assert np.abs(got - want).max() <= 1
    assert np.array_equal(tile_of(preprocess.flatfield_correct(from_numpy(a, ("y", "x")), 2.0, 5.0)), t)
    assert not tile_of(preprocess.flatfield_correct(from_numpy(a * 0, ("y", "x")), flat, 0.0)).any()


def test_flatfield_cuts_towards_zero(spark):
    """The largest pixel stays as it was, and a value just below a whole number is cut, not rounded."""
    a = np.array([[10, 7], [3, 1]], dtype=np.uint16)
    got = tile_of(preprocess.flatfield_correct(from_numpy(a, ("y", "x")), np.array([[1.0, 1.0], [1.0, 1.0000001]]), 0.0))
    assert got.tolist() == [[10, 7], [3, 0]]


def test_circle_mask(spark):
    a = 1 + cube(64, 64)
    got = tile_of(preprocess.circle_mask(from_numpy(a, ("y", "x")), 21, (30, 33)))
    assert np.array_equal(got, a * disk_mask(64, (30, 33), 10))
    other = tile_of(preprocess.circle_mask(from_numpy(a, ("y", "x")), 21, (30, 33), invert=True))
    assert np.array_equal(other + got, a)


def test_rename_and_rotate(spark):
    assay = from_numpy(cube(2, 4, 4), ("channel", "y", "x"), {"channel": ["a", "b"]})
    names = lambda x: sorted(r[0] for r in x["tiles"].select("channel").distinct().collect())
    assert names(preprocess.rename_labels(assay, "channel", {"a": "red"})) == ["b", "red"]
    assert names(preprocess.rename_labels(assay, "channel", ["p", "q"])) == ["p", "q"]
    with pytest.raises(ValueError):
        preprocess.rename_labels(assay, "channel", ["p"])
    with pytest.warns(UserWarning):
        assert preprocess.rotate(assay, 3) is assay


def test_basic_correct_takes_a_model(spark):
    class Halve:
        def fit(self, stack):
            self.n = len(stack)

        def transform(self, stack):
            return stack / 2

    a = cube(4, 5)
    assert np.allclose(tile_of(preprocess.basic_correct(from_numpy(a, ("y", "x")), Halve)), a / 2)
    with pytest.raises(ImportError):
        preprocess.basic_correct(from_numpy(a, ("y", "x")))
