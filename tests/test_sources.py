import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

import spotlake as sl
from spotlake.operators.finish import to_numpy
from spotlake.sources import paths, tables, tiff
from spotlake.sources.reader import read


def test_templates():
    t = "(assay)/(channel)_(time|%Y-%m-%d)_(dose__channel|float)_(row)_(col).tif"
    assert [(s.name, s.kind, s.of) for s in paths.specifiers(t)] == [("assay", "str", None), ("channel", "str", None), ("time", "time", None), ("dose", "float", "channel"), ("row", "int", None), ("col", "int", None)]
    assert paths.glob_of(t) == "*/*_*_*_*_*.tif"
    assert paths.spark_pattern("%Y%m%d-%H%M%S") == "yyyyMMdd-HHmmss"
    with pytest.raises(ValueError):
        paths.specifiers("(timestamp).tif")


def write_grid(folder, gap=False):
    a = np.random.default_rng(0).integers(0, 900, (2, 2, 2, 10, 12)).astype(np.uint16)
    for c, name in enumerate(("gfp", "bf")):
        (folder / name).mkdir()
        for i in range(2):
            for j in range(2):
                if not (gap and c == i == j == 1):
                    tiff.write_tiff(str(folder / name / f"20240102-03040{c}_{i}_{j}.tif"), a[c, i, j])
    return a


def test_tiles_from_files(spark, tmp_path):
    a = write_grid(tmp_path)
    image = sl.image(f"{tmp_path}/(channel)/*_(row)_(col).tif", overlap=0)
    got = to_numpy(image, "image")
    want = np.stack([np.block([[a[c, 0, 0], a[c, 0, 1]], [a[c, 1, 0], a[c, 1, 1]]]) for c in (1, 0)])  # bf comes before gfp
    assert np.array_equal(got.reshape(want.shape), want)


def test_incomplete_missing_and_double(spark, tmp_path):
    write_grid(tmp_path, gap=True)
    with pytest.raises(ValueError, match="complete"):
        list(read(f"{tmp_path}/(channel)/*_(row)_(col).tif"))
    with pytest.raises(FileNotFoundError):
        list(read(f"{tmp_path}/none/(channel)_(row).tif"))
    with pytest.raises(ValueError, match="same indices"):
        list(read(f"{tmp_path}/(channel)/*_(row)_*.tif"))


def test_stack_in_one_file_and_attached(spark, tmp_path):
    pages = np.arange(3 * 5 * 4, dtype=np.uint16).reshape(3, 5, 4)
    for k in (2, 10):
        tiff.write_tiff(str(tmp_path / f"s{k}_q7.tif"), pages + k, json.dumps({"axes": "TYX", "shape": [3, 5, 4]}))
    assays = list(read(f"{tmp_path}/(assay)_q*.tif"))
    assert [a.attrs["name"] for a in assays] == ["s2", "s10"]
    px = assays[1]["tiles"].orderBy("time_idx").collect()
    assert [r.time_idx for r in px] == [0, 1, 2] and px[2].px == (pages[2] + 10.0).ravel().tolist()
    extra = {r.label: r.extra for r in next(iter(read(f"{tmp_path}/s(channel)_q(dose_channel|int).tif")))["dims"].filter("dim = 'channel'").collect()}
    assert extra == {"2": {"dose": "7"}, "10": {"dose": "7"}}


def test_axes_are_checked():
    with pytest.raises(ValueError):
        tiff.check_axes({"C": 2}, {"channel"})
    with pytest.raises(ValueError):
        tiff.axes_of({tiff.DESCRIPTION: "ImageJ=1\nslices=4\n"})
    assert tiff.axes_of({tiff.DESCRIPTION: '<OME><Pixels DimensionOrder="XYCZT" SizeC="2" SizeT="3" SizeZ="1"/></OME>'}) == {"T": 3, "C": 2}


def test_acquisition_gives_times_and_channels(spark, tmp_path):
    pages = np.arange(6 * 3 * 4, dtype=np.uint16).reshape(6, 3, 4)
    planes = "".join(f'<Plane TheT="{i // 2}" TheC="{i % 2}" DeltaT="{1000 * (i // 2) + 10 * (i % 2)}.0" DeltaTUnit="ms"/>' for i in range(6))
    ome = f'<OME><Image><Pixels DimensionOrder="XYCZT" SizeC="2" SizeT="3" SizeZ="1">{planes}</Pixels></Image></OME>'
    told = {"StartTime": "2024-01-02 03:04:05.500 -0800", "ChNames": ["gfp", "bf"]}
    tiff.write_tiff(str(tmp_path / "x_0.tif"), pages, ome, told)
    a = next(iter(read(f"{tmp_path}/x_(col).tif")))
    dims = [(r.dim, r.label) for r in a["dims"].orderBy("dim", "idx").collect()]
    assert dims == [("channel", "gfp"), ("channel", "bf"), ("time", "1704164645"), ("time", "1704164646"), ("time", "1704164647")]
    got = {(r.channel, r.time_idx): r.px for r in a["tiles"].collect()}
    assert got[("bf", 2)] == pages[5].astype(float).ravel().tolist() and a.attrs["original_dims"] == ("channel", "time", "col", "y", "x")
    own = next(iter(read(f"{tmp_path}/x_(col).tif", times=[7, 8, 9])))
    assert [r.label for r in own["dims"].filter("dim = 'time'").orderBy("idx").collect()] == ["7", "8", "9"]
    tiff.write_tiff(str(tmp_path / "single.tif"), pages[0], summary=told)
    assert [r.label for r in next(iter(read(f"{tmp_path}/single.tif")))["dims"].filter("dim = 'time'").collect()] == ["1704164645"]


def packed_lzw(data):
    """An encoder of its own: codes of 9 to 12 bits, the highest bit first."""
    table, bits, width, word = {bytes([i]): i for i in range(256)}, [], 9, b""

    def put(code):
        bits.extend((code >> i) & 1 for i in range(width - 1, -1, -1))

    put(256)
    n = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = c
    put(table[word])
    n += 1
    width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def packed_file(image, how, pack, predictor=1, tile=None, big=False):
    """One page in strips of five rows, or in tiles, packed by `pack`."""
    h, w = image.shape
    th, tw = tile or (5, w)
    parts = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            part = image[y : y + th, x : x + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
            parts.append(pack(np.ascontiguousarray(part.astype("<u2")).tobytes()))
    head = 16 if big else 8
    offsets = [head + sum(map(len, parts[:i])) for i in range(len(parts))]
    body, at = b"".join(parts), head + sum(map(len, parts))
    word = "Q" if big else "I"
    lists, kinds = b"".join(struct.pack(f"<{len(parts)}{word}", *v) for v in (offsets, [len(p) for p in parts])), 16 if big else 4
    size = struct.calcsize(word)
    where = [at, at + size * len(parts)] if len(parts) > 1 else [offsets[0], len(parts[0])]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, how), *([] if tile else [(273, kinds, len(parts), where[0]), (278, 4, 1, th), (279, kinds, len(parts), where[1])]), (317, 3, 1, predictor)]
    tags += [(322, 4, 1, tw), (323, 4, 1, th), (324, kinds, len(parts), where[0]), (325, kinds, len(parts), where[1])] if tile else []
    at += len(lists)
    ifd = struct.pack("<Q" if big else "<H", len(tags)) + b"".join(struct.pack(f"<HH{word}{word}", *t) for t in tags) + struct.pack(f"<{word}", 0)
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return start + body + lists + ifd


@pytest.mark.parametrize("big", [False, True])
def test_packed_strips_and_tiles(big):
    image = (np.add.outer(np.arange(23) * 7, np.arange(37) // 3) % 300).astype(np.uint16)
    image[3:9, 5:30] = np.random.default_rng(0).integers(0, 60_000, (6, 25))
    for how, pack in ((1, bytes), (8, zlib.compress), (5, packed_lzw), (32773, lambda b: b"".join(bytes([len(b[i : i + 100]) - 1]) + b[i : i + 100] for i in range(0, len(b), 100)))):
        for predictor in (1, 2):
            for tile in (None, (16, 16)):
                data = packed_file(image, how, pack, predictor, tile, big)
                assert np.array_equal(tiff.page_array(data, tiff.directories(data)[0]), image)
    long = np.random.default_rng(1).integers(0, 9, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw(packed_lzw(long)) == long and tiff.unpacked(bytes([254, 7, 128, 1, 5, 6])) == b"\x07\x07\x07\x05\x06"


def test_pins_and_spectra(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Indices,MutantID\n"(1, 2)",wt\n"(2, 1)",BLANK\n')
    got = {(r.mark_row, r.mark_col): r.tag for r in tables.read_pinlist(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {(1, 0): "wt", (0, 1): "BLANK"}
    pd.DataFrame({"name": ["eu", "dy"], "c0": [0.5, 0.1], "c1": [0.2, 0.9]}).to_csv(tmp_path / "s.csv", index=False)
    assert tables.read_spectra(str(tmp_path / "s.csv")).loc["dy", "c1"] == 0.9


def test_zarr_is_refused():
    with pytest.raises(NotImplementedError):
        list(read("x.zarr"))
