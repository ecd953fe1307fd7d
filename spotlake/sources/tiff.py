"""TIFF stacks: a parser of files, a Spark data source over it, and the metadata of microscopes."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Field types (size and struct letter) and tags of the TIFF format.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, COUNTS, FORMAT = 256, 257, 258, 259, 270, 273, 279, 339
ROWS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 278, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, PACKED = 1, 5, (8, 32946), 32773
#: Fixed value: what stands before the length of an acquisition summary.
SUMMARY = 2355492


def directories(data: bytes) -> list[dict[int, object]]:
    """The fields of every page of a classic or a big file."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    version = struct.unpack(e + "H", data[2:4])[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    # letters and sizes of the number of fields, of counts and of offsets
    n_of, n_size, word, size_of_word, start = ("H", 2, "I", 4, 4) if version == 42 else ("Q", 8, "Q", 8, 8)
    at, out = struct.unpack(e + word, data[start : start + size_of_word])[0], []
    field = 4 + 2 * size_of_word
    while at:
        n = struct.unpack(e + n_of, data[at : at + n_size])[0]
        page: dict[int, object] = {0: e}
        for i in range(n):
            place = at + n_size + field * i
            tag, kind, count = struct.unpack(e + "HH" + word, data[place : place + 4 + size_of_word])
            size, letter = TYPES.get(kind, (1, "B"))
            place += 4 + size_of_word
            if size * count > size_of_word:
                place = struct.unpack(e + word, data[place : place + size_of_word])[0]
            raw = data[place : place + size * count]
            page[tag] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(e + letter * count, raw)
        out.append(page)
        end = at + n_size + field * n
        at = struct.unpack(e + word, data[end : end + size_of_word])[0]
    return out


def unpacked(data: bytes) -> bytes:
    """Runs of bytes: n + 1 bytes as they are, or one byte 1 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 begins anew, 257 ends."""
    out, words, bits, held, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        word = words[code] if code < len(words) else last + last[:1]
        if last:
            words.append(last + word[:1])
        out += word
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out)


def page_array(data: bytes, page: dict[int, object]) -> np.ndarray:
    """The pixels of a page, whose strips or tiles may be packed."""
    how, height, width = page.get(COMPRESSION, (PLAIN,))[0], page[HEIGHT][0], page[WIDTH][0]
    tiled = TILE_OFFSETS in page
    kind = {1: "u", 2: "i", 3: "f"}[page.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{page[0]}{kind}{page[BITS][0] // 8}")
    part_h, part_w = (page[TILE_HEIGHT][0], page[TILE_WIDTH][0]) if tiled else (min(page.get(ROWS, (height,))[0], height), width)
    across = -(-width // part_w)
    out = np.empty((height, width), dtype=dtype)
    for i, (offset, count) in enumerate(zip(page[TILE_OFFSETS if tiled else OFFSETS], page[TILE_COUNTS if tiled else COUNTS])):
        body = data[offset : offset + count]
        if how == LZW:
            body = lzw(body)
        elif how in DEFLATE:
            body = zlib.decompress(body)
        elif how == PACKED:
            body = unpacked(body)
        elif how != PLAIN:
            raise ValueError(f"pages of compression {how} are not read")
        y, x = i // across * part_h, i % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        part = np.frombuffer(body, dtype=dtype, count=rows * part_w).reshape(rows, part_w)
        if page.get(PREDICTOR, (1,))[0] == 2:  # differences along rows
            part = np.cumsum(part, axis=1, dtype=dtype)
        elif page.get(PREDICTOR, (1,))[0] != 1:
            raise ValueError("pages with differences of fractions are not read")
        out[y : y + rows, x : x + part_w] = part[: height - y, : width - x]
    return out


def axes_of(page: dict[int, object]) -> dict[str, int]:
    """axis -> length of the stack, from an OME, ImageJ-like or JSON description; by default pages are channels. R is left out, Z refused."""
    text = str(page.get(DESCRIPTION, ""))
    if order := re.search(r'DimensionOrder="XY([CZT]{3})"', text):  # from the fastest axis to the slowest
        size = dict(re.findall(r'Size([CZT])="(\d+)"', text))
        axes = {a: int(size.get(a, 1)) for a in reversed(order[1]) if int(size.get(a, 1)) > 1}
    elif text.startswith("{"):
        told = json.loads(text)
        axes = dict(zip(told.get("axes", ""), told.get("shape", [])))
    else:
        counts = dict(re.findall(r"(channels|frames|slices)=(\d+)", text))
        axes = {k: int(counts[n]) for k, n in (("T", "frames"), ("Z", "slices"), ("C", "channels")) if int(counts.get(n, 1)) > 1}
    if axes.get("Z", 1) > 1:
        raise ValueError("stacks over z are not read")
    return {k: int(v) for k, v in axes.items() if k not in "RZYX"}


def check_axes(in_file: dict[str, int], in_path: set[str]) -> None:
    clash = {"C": "channel", "T": "time"}
    both = [clash[a] for a in in_file if clash.get(a) in in_path]
    if both:
        raise ValueError(f"the path and the file both have {', '.join(both)}")


def bytes_of(path: str) -> bytes:
    """A file by path or URI."""
    with pafs.FileSystem.from_uri(path)[0].open_input_file(pafs.FileSystem.from_uri(path)[1]) if "://" in path else open(path, "rb") as f:
        return f.read()


def pages_of(data: bytes, path: str = "") -> list[dict]:
    """channel and time index, size, type and pixels of each page of a file, and what it notes of its acquisition."""
    dirs = directories(data)
    axes = axes_of(dirs[0]) or ({"C": len(dirs)} if len(dirs) > 1 else {})
    if int(np.prod(list(axes.values()), dtype=int)) != len(dirs):
        raise ValueError(f"{path} has {len(dirs)} pages, its axes {axes}")
    start, names = acquisition(data)
    delays = re.findall(r'<Plane\b[^>]*?\bDeltaT="([^"]+)"', str(dirs[0].get(DESCRIPTION, "")))
    if len(delays) != len(dirs) or 'DeltaTUnit="s"' in str(dirs[0].get(DESCRIPTION, "")):
        delays = [None] * len(dirs)
    out = []
    for i, page in enumerate(dirs):
        at = dict(zip(axes, np.unravel_index(i, tuple(axes.values())))) if axes else {}
        a = page_array(data, page)
        out.append({"start": start, "names": names, "delta_ms": delays[i] and float(delays[i]), "c": int(at.get("C", 0)), "t": int(at.get("T", 0)), "height": a.shape[0], "width": a.shape[1], "dtype": a.dtype.newbyteorder("=").name, "px": a.astype(np.float64).ravel().tolist()})
    return out


def read_page(path: str) -> np.ndarray:
    p = pages_of(bytes_of(path), path)[0]
    return np.asarray(p["px"]).reshape(p["height"], p["width"])


PAGE = "path string, c int, t int, height int, width int, dtype string, px array<double>, start string, delta_ms double, names array<string>"


class TiffSource(DataSource):
    """spark.read.format("tiff").load(folder or file): a row per page; a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for pattern in self.paths for p in sorted(glob.glob(pattern) or [pattern])]

    def read(self, partition):
        for p in pages_of(bytes_of(partition.value), partition.value):
            yield (partition.value, p["c"], p["t"], p["height"], p["width"], p["dtype"], p["px"], p["start"], p["delta_ms"], p["names"])


def plane_times(planes: DataFrame, start: Column, delta_ms: str = "delta_ms") -> DataFrame:
    """planes with time: start (a string such as 2024-01-02 03:04:05.678 -0800, whose zone is left out) plus milliseconds, in whole seconds."""
    clean = F.regexp_replace(start, r"\s*[+-]\d{4}$", "")
    began = F.coalesce(*[F.try_to_timestamp(clean, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")])
    return planes.withColumn("time", F.floor((F.unix_millis(began) + F.col(delta_ms)) / 1000).cast("long"))


def acquisition(data: bytes) -> tuple[str | None, list[str] | None]:
    """Start and channel names from the acquisition summary that Micro-Manager puts behind the header of a file, if there is one."""
    if len(data) < 40:
        return None, None
    mark, size = struct.unpack(("<" if data[:2] == b"II" else ">") + "II", data[32:40])
    if mark != SUMMARY:
        return None, None
    told = json.loads(data[40 : 40 + size].rstrip(b"\0 ").decode("utf-8", "replace"))
    return told.get("StartTime"), told.get("ChNames")


def ravel(index: list[Column], sizes: list[int]) -> Column:
    """Position in row-major order."""
    out = F.lit(0).cast("long")
    for c, n in zip(index, sizes):
        out = out * n + c
    return out


def write_tiff(path: str, pages: np.ndarray, description: str = "", summary: dict | None = None) -> None:
    """Uncompressed little-endian pages (n, y, x), with an acquisition summary if one is given; for tests and small exports."""
    pages = np.asarray(pages)
    pages = pages[None] if pages.ndim == 2 else pages
    kind = {"u": 1, "i": 2, "f": 3}[pages.dtype.kind]
    told = json.dumps(summary).encode() if summary else b""
    told += b" " * (len(told) % 2)
    out = bytearray(b"II*\0" + struct.pack("<I", 40 + len(told) if told else 8))
    if told:
        out += struct.pack("<8I", 0, 0, 0, 0, 0, 0, SUMMARY, len(told)) + told
    text = description.encode() + b"\0"
    n_tags = 8 + bool(description)
    for i, page in enumerate(pages):
        body = page.astype(page.dtype.newbyteorder("<")).tobytes()
        at = len(out)
        data_at = at + 2 + 12 * n_tags + 4
        text_at = data_at + len(body)
        end = text_at + (len(text) if description else 0)
        tags = [(WIDTH, 4, 1, page.shape[1]), (HEIGHT, 4, 1, page.shape[0]), (BITS, 3, 1, 8 * page.dtype.itemsize), (COMPRESSION, 3, 1, 1)]
        if description:
            tags.append((DESCRIPTION, 2, len(text), text_at if len(text) > 4 else int.from_bytes(text.ljust(4, b"\0"), "little")))
        tags += [(OFFSETS, 4, 1, data_at), (278, 4, 1, page.shape[0]), (COUNTS, 4, 1, len(body)), (FORMAT, 3, 1, kind)]
        out += struct.pack("<H", len(tags))
        for tag in tags:
            out += struct.pack("<HHII", *tag)
        end += end % 2
        out += struct.pack("<I", 0 if i == len(pages) - 1 else end) + body + (text if description else b"")
        out += b"\0" * (end - len(out))
    with open(path, "wb") as f:
        f.write(bytes(out))


def pages(files: DataFrame) -> DataFrame:
    """The pages of files (path, content and other columns) with the other columns. Spark reads the files, so they may lie in any store it knows."""
    own = [f for f in files.schema.fields if f.name not in ("path", "content")]
    told = T.StructType.fromDDL(PAGE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                out = pd.DataFrame(pages_of(bytes(row["content"]), row["path"])).assign(path=row["path"])
                for f in own:
                    out[f.name] = [row[f.name]] * len(out)
                yield out[[f.name for f in [*told.fields, *own]]]

    return files.mapInPandas(run, T.StructType([*told.fields, *own]))
