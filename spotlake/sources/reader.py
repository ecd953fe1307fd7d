"""The reader `read`: arrays and assays as they are, path templates expanded, one assay after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.columns import natural_key
from spotlake.model import Assay, from_numpy, table
from spotlake.pipeline import reader
from spotlake.session import current
from spotlake.sources import tiff
from spotlake.sources.paths import attached, list_files, specifiers, with_content
from spotlake.sources.tables import load


def labels(listed: DataFrame, column: str) -> list:
    """The values of a captured column: names in natural order, numbers by size."""
    named = dict(listed.dtypes)[column] == "string"
    order = [natural_key(F.col(column)), column] if named else [column]
    return [r[0] for r in listed.select(column).distinct().orderBy(*order).collect()]


@reader("read")
def read(data, dims: tuple[str, ...] | None = None, times: list[int] | None = None) -> Iterator[Assay]:
    """data: an array (with dims, by default y, x or channel, y, x), an Assay, a path template, or a list of such.

    times: seconds of the times within files, in place of those that the files note.
    """
    for item in data if isinstance(data, (list, tuple)) else [data]:
        if isinstance(item, Assay):
            yield item
        elif isinstance(item, np.ndarray):
            yield from_numpy(item, dims or {2: ("y", "x"), 3: ("channel", "y", "x"), 4: ("channel", "time", "y", "x"), 6: ("channel", "time", "row", "col", "y", "x")}[item.ndim])
        elif str(item).rstrip("/").endswith((".zarr", ".zarray")):
            raise NotImplementedError("zarr folders are not read; save assays with save(), or pass arrays")
        elif str(item).rstrip("/").endswith(".assay"):
            yield load(str(item))
        else:
            yield from _files(str(item), times)


def _files(template: str, given_times: list[int] | None) -> Iterator[Assay]:
    spark = current()
    listed = list_files(spark, template).persist()
    given = {s.name for s in specifiers(template) if s.of is None}
    try:
        for name in labels(listed, "assay") if "assay" in given else [""]:
            yield _assay(listed.filter(F.col("assay") == name) if "assay" in given else listed, name, template, given, given_times)
    finally:
        listed.unpersist()


def _assay(files: DataFrame, name: str, template: str, given: set[str], given_times: list[int] | None) -> Assay:
    blobs = with_content(current(), template)
    pages = tiff.pages(blobs.filter(F.col("assay") == name) if "assay" in given else blobs)
    told = pages.agg(F.max("c"), F.max("t"), F.count(F.lit(1)), F.min_by("start", "path"), F.min_by("names", "path")).first()
    axes = {"C": told[0] + 1, "T": told[1] + 1}
    tiff.check_axes({k: v for k, v in axes.items() if v > 1}, given)
    channels = labels(files, "channel") if "channel" in given else told[4] if told[4] and len(told[4]) == axes["C"] else [str(i) for i in range(axes["C"])]
    times = labels(files, "time") if "time" in given else given_times or _recorded(pages, told[3], axes["T"]) or list(range(axes["T"]))
    if "time" not in given and len(times) != axes["T"]:
        raise ValueError(f"{len(times)} times are given for {axes['T']}")
    grid = {d: labels(files, d) for d in ("row", "col") if d in given}
    size = len(channels) * len(times) * int(np.prod([len(v) for v in grid.values()], dtype=int))
    if told[2] != size:
        raise ValueError(f"the tiles of {name or template} are not complete: {told[2]} pages, {size} expected")
    kinds = dict(files.dtypes)
    place = lambda values, c: F.element_at(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v).cast(kinds[c]), F.lit(i))]), F.col(c))
    rank = lambda d: place(grid[d], d) if d in grid else F.lit(0)
    channel = F.col("channel") if "channel" in given else F.element_at(F.array(*map(F.lit, channels)), F.col("c") + 1)
    tiles = pages.select(
        F.lit(name).alias("assay"), channel.alias("channel"), (place(times, "time") if "time" in given else F.col("t")).cast("int").alias("time_idx"), rank("row").cast("int").alias("tile_row"),
        rank("col").cast("int").alias("tile_col"), "height", "width", "dtype", "px",
    )
    more: dict[tuple[str, str], dict[str, str]] = {}
    for s in (s for s in specifiers(template) if s.of is not None):
        for r in attached(files, s.name, s.of).filter(F.col(s.name).isNotNull()).collect():
            more.setdefault((s.of, str(r[s.of])), {})[s.name] = str(r[s.name])
    rows = [(name, dim, i, str(v), more.get((dim, str(v)), {})) for dim, values in (("channel", channels), ("time", times)) for i, v in enumerate(values)]
    original = tuple(d for d in ("channel", "time", "row", "col") if d in given or axes.get({"channel": "C", "time": "T"}.get(d, ""), 1) > 1)
    return Assay({"tiles": tiles, "dims": table("dims", rows)}, {"name": name, "original_dims": (*original, "y", "x")})


def _recorded(pages: DataFrame, start: str | None, count: int) -> list[int] | None:
    """The times that the first file's acquisition notes: its start, and the delays of its planes where it holds several times."""
    if not start:
        return None
    first = pages.select("path", "c", "t", "delta_ms").orderBy("path", "t", "c").limit(count * (1 + pages.agg(F.max("c")).first()[0]))
    delays = first.filter("c = 0").withColumn("delta_ms", F.coalesce("delta_ms", F.lit(0.0) if count == 1 else F.lit(None).cast("double")))
    rows = tiff.plane_times(delays, F.lit(start)).select("t", "time").orderBy("t").collect()
    times = [r["time"] for r in rows]
    return times if len(times) == count and None not in times else None
