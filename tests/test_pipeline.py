import numpy as np
import pytest

import spotlake as sl
from spotlake.model import Assay, from_numpy
from spotlake.operators import finish
from spotlake.pipeline import Pipeline, component


def same(assay):
    return assay


def test_positions():
    p = Pipeline("read")
    p.add_pipe(same, name="a")
    p.add_pipe(same, name="b", first=True)
    p.add_pipe(same, name="c", after="b")
    p.add_pipe(same, name="d", before=0)
    p.add_pipe(same, name="e", after=-1)
    assert p.names == ["d", "b", "c", "a", "e"]
    p.remove_pipe("c")
    assert p.names == ["d", "b", "a", "e"]


def test_refusals():
    p = Pipeline("read")
    with pytest.raises(ValueError):
        p.remove_pipe("a")
    p.add_pipe(same, name="a")
    for bad in (dict(what=same, name="a"), dict(what="no such"), dict(what=same, name="b", after="z"), dict(what=same, name="b", first=True, last=True), dict(what=same, name="b", before=7)):
        with pytest.raises(ValueError):
            p.add_pipe(**bad)
    with pytest.raises(ValueError):
        p.remove_pipe("z")
    with pytest.raises(ValueError):
        Pipeline("no such reader")


def test_components_and_unwrapping(spark):
    @component("note_that")
    def note_that(assay, value=1):
        return assay.noting(value=value)

    p = Pipeline("read")
    p.add_pipe("note_that", value=7)
    one = p(np.ones((4, 4)))
    assert isinstance(one, Assay) and one.attrs["value"] == 7
    assert len(p([np.ones((4, 4)), np.zeros((4, 4))])) == 2


def test_save_load_and_cache(spark, tmp_path):
    a = sl.image(from_numpy(np.arange(48.0).reshape(6, 8), ("y", "x")), overlap=2)
    sl.save(str(tmp_path / "x.assay"), a.cache())
    b = sl.load(str(tmp_path / "x.assay"))
    assert b.attrs["original_dims"] == ("y", "x")
    assert [r.px for r in b["image"].collect()] == [r.px for r in a["image"].collect()]
    assert "tiles" not in b and "image" in b


def test_presets_refuse():
    with pytest.raises(ValueError):
        sl.microfluidic_chip_pipe(chip_type="other")
    assert sl.mrbles_pipe("s", "c").names == ["standardize_format", "flatfield_correct", "stitch", "find_beads", "identify_mrbles", "drop", "restore_format"]
    assert sl.beads_pipe().names[3] == "find_beads" and sl.image_pipe().names[1] == "stitch"
    assert sl.microfluidic_chip_pipe(chip_type="pc").names[1] == "identify_buttons"


def test_restored_dimensions(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(1, 90, (3, 4, 6, 5, 2)).astype(float)
    given = from_numpy(a, ("time", "plate", "y", "x", "channel"))
    for restored, want in ((False, ("channel", "time", "im_y", "im_x")), (True, ("time", "plate", "channel", "im_y", "im_x"))):
        p = sl.Pipeline("read")
        for step in ("standardize_format", "stitch", *(["restore_format"] if restored else [])):
            p.add_pipe(step, **({"overlap": 0} if step == "stitch" else {}))
        out = p(given)
        assert finish.output_dims(out, "image") == want
        got = finish.to_numpy(out, "image")
        assert got.shape == ((3, 4, 2, 6, 5) if restored else (2, 12, 6, 5))
        if restored:
            assert np.array_equal(got, a.transpose(0, 1, 4, 2, 3))
    flat = sl.image(a[0, 0, :, :, 0], overlap=0)
    assert finish.output_dims(flat, "image") == ("im_y", "im_x") and np.array_equal(finish.to_numpy(flat, "image"), a[0, 0, :, :, 0])
