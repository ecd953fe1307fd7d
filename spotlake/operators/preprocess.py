"""Tiles in a standard form, corrected and mirrored. All steps but the external illumination model are expressions on rows of tiles."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.columns import once
from spotlake.model import SCHEMAS, Assay
from spotlake.operators.geometry import disk
from spotlake.pipeline import component


def _by_place(px: str, change: Callable[[Column, Column, Column], Column]) -> Column:
    """px with change(value, y, x) applied; px lies row by row, `width` pixels a row."""
    return F.transform(px, lambda v, i: change(v, F.floor(i / F.col("width")).cast("int"), (i % F.col("width")).cast("int")))


@component("standardize_format")
def standardize_format(assay: Assay) -> Assay:
    """Tiles with exactly the standard columns: short names are renamed, missing dimensions get one label, further ones go into time."""
    tiles = assay["tiles"]
    for old, new in {"row": "tile_row", "col": "tile_col", "time": "time_idx"}.items():
        if old in tiles.columns and new not in tiles.columns:
            tiles = tiles.withColumnRenamed(old, new)
    wanted = [f.split()[0] for f in SCHEMAS["tiles"].split(", ")]
    for c, default in {"assay": F.lit(""), "channel": F.lit("0"), "time_idx": F.lit(0), "tile_row": F.lit(0), "tile_col": F.lit(0), "dtype": F.lit("float64")}.items():
        if c not in tiles.columns:
            tiles = tiles.withColumn(c, default)
    extra = [c for c in tiles.columns if c not in wanted]
    if extra:
        tiles = stacked_time(tiles, extra)
    return assay.with_(tiles=tiles.select(*wanted))


def stacked_time(df: DataFrame, extra: Sequence[str]) -> DataFrame:
    """time_idx counts the combinations of time_idx and the extra columns, which go. The combinations are few: they are ranked apart and joined."""
    from pyspark.sql import Window

    ranked = df.select("time_idx", *extra).distinct().withColumn("stacked", F.row_number().over(Window.orderBy("time_idx", *extra)) - 1)
    return df.join(ranked, ["time_idx", *extra]).drop("time_idx", *extra).withColumnRenamed("stacked", "time_idx")


@component("rename_labels")
def rename_labels(assay: Assay, dim: str = "channel", labels: Mapping[str, str] | Sequence[str] | None = None) -> Assay:
    """New labels of a dimension: old -> new, or all of them in order."""
    if labels is None:
        return assay
    if not isinstance(labels, Mapping):
        old = [r["label"] for r in assay["dims"].filter(F.col("dim") == dim).select("idx", "label").distinct().orderBy("idx").collect()]
        if len(old) != len(labels):
            raise ValueError(f"{dim} has {len(old)} labels, not {len(labels)}")
        labels = dict(zip(old, labels))
    swap = relabelled("label", labels)
    out = assay.map("dims", lambda d: d.withColumn("label", F.when(F.col("dim") == dim, swap).otherwise(F.col("label"))))
    for name, df in out.tables.items():
        if dim in df.columns and name != "dims":
            out = out.with_(**{name: df.withColumn(dim, relabelled(dim, labels))})
    return out


def relabelled(column: str, labels: Mapping[str, str]) -> Column:
    if not labels:
        return F.col(column)
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(column)), F.col(column))


@component("rotate")
def rotate(assay: Assay, rotation: float = 0) -> Assay:
    """Accepted and without effect; anything but 0 is warned about."""
    if rotation:
        warnings.warn("rotation is not applied", stacklevel=2)
    return assay


def _field(field, name: str, like: DataFrame) -> DataFrame | float:
    if isinstance(field, (int, float)):
        return float(field)
    if isinstance(field, str):
        from spotlake.sources.tiff import read_page

        field = read_page(field)
    if isinstance(field, np.ndarray):
        field = {"default": field}
    rows = [(c, np.asarray(v, dtype=np.float64).ravel().tolist()) for c, v in field.items()]
    return like.sparkSession.createDataFrame(rows, f"channel string, {name} array<double>")


def align_field(tiles: DataFrame, field: DataFrame, name: str) -> DataFrame:
    """tiles with the field of their channel, or else the one labelled `default`. A field has a row per channel, so it is small."""
    default = field.filter(F.col("channel") == "default").select(F.col(name).alias("_default"))
    own = field.filter(F.col("channel") != "default")
    return tiles.join(F.broadcast(own), "channel", "left").join(F.broadcast(default), F.lit(True), "left").withColumn(name, F.coalesce(name, "_default")).drop("_default")


@component("flatfield_correct")
def flatfield_correct(assay: Assay, flatfield=1.0, darkfield=0.0) -> Assay:
    """Subtract the dark field (not below 0), divide by the flat field, restore the old maximum, and cut to the tiles' type.

    Fields: numbers, arrays, paths of TIFF files, or channel -> array with an optional `default`. A flat field that is
    a number cancels out, so then no maximum is computed.
    """
    tiles = assay["tiles"]
    flat, dark = _field(flatfield, "_flat", tiles), _field(darkfield, "_dark", tiles)
    columns = tiles.columns
    if isinstance(dark, DataFrame):
        tiles = align_field(tiles, dark, "_dark").withColumn("px", F.zip_with("px", "_dark", lambda v, d: F.greatest(v - F.coalesce(d, F.lit(0.0)), F.lit(0.0))))
    else:
        tiles = tiles.withColumn("px", F.transform("px", lambda v: F.greatest(v - F.lit(dark), F.lit(0.0))))
    if isinstance(flat, DataFrame):
        tiles = align_field(tiles, flat, "_flat").withColumn("_raw", F.array_max("px")).withColumn("px", F.zip_with("px", "_flat", lambda v, f: F.coalesce(F.try_divide(v, f), F.lit(0.0))))
        tops = tiles.groupBy("assay").agg(F.max("_raw").alias("_top"), F.max(F.array_max("px")).alias("_now"))
        tiles = tiles.join(F.broadcast(tops), "assay").withColumn("px", F.transform("px", lambda v: F.coalesce(F.try_divide(v * F.col("_top"), F.col("_now")), F.lit(0.0))))
    whole = F.col("dtype").rlike("int")
    return assay.with_(tiles=tiles.withColumn("px", F.when(whole, F.transform("px", lambda v: F.floor(v).cast("double"))).otherwise(F.col("px"))).select(*columns))


@component("basic_correct")
def basic_correct(assay: Assay, model: Callable[[], object] | None = None) -> Assay:
    """Fit an illumination model per channel on the tiles of time 0 and apply it to all. model() must have fit(stack) and transform(stack)."""
    if model is None:
        raise ImportError("basic_correct needs an illumination model: pass model=, a class with fit(stack) and transform(stack)")
    tiles = assay["tiles"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        stack = np.stack([np.asarray(p, dtype=np.float64).reshape(h, w) for p in pdf["px"]])
        fitted = model()
        fitted.fit(stack[(pdf["time_idx"] == pdf["time_idx"].min()).to_numpy()])
        return pdf.assign(px=[p.ravel().tolist() for p in fitted.transform(stack)])

    return assay.with_(tiles=tiles.groupBy("assay", "channel").applyInPandas(run, tiles.schema))


def _mirrored(assay: Assay, horizontal: bool) -> Assay:
    name = "image" if "image" in assay else "tiles"
    df = assay[name]
    rows = lambda px: F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.slice(px, y * F.col("width") + 1, F.col("width")))
    turned = once(F.col("px"), lambda px: F.flatten(F.transform(rows(px), F.reverse) if horizontal else F.reverse(rows(px))))
    if name == "image":
        start, size = ("x0", "width") if horizontal else ("y0", "height")
        ends = df.groupBy("assay").agg(F.max(F.col(start) + F.col(size)).alias("_end"))
        df = df.join(F.broadcast(ends), "assay").withColumn(start, (F.col("_end") - F.col(start) - F.col(size)).cast("int")).drop("_end")
    return assay.with_(**{name: df.withColumn("px", turned).select(*assay[name].columns)})


@component("horizontal_flip")
def horizontal_flip(assay: Assay) -> Assay:
    """Mirror the image by x, or each tile where there is no image yet (the order of tiles stays)."""
    return _mirrored(assay, True)


@component("vertical_flip")
def vertical_flip(assay: Assay) -> Assay:
    return _mirrored(assay, False)


@component("circle_mask")
def circle_mask(assay: Assay, diameter: int, center: tuple[int, int], invert: bool = False) -> Assay:
    """Zero outside (inside if invert) the filled disk of radius diameter // 2 around center (row, col) of the image, or of each tile."""
    name = "image" if "image" in assay else "tiles"
    spans = {int(dy) + center[0]: (int(x.min()) + center[1], int(x.max()) + center[1]) for dy, x in pd.DataFrame(disk(diameter // 2), columns=["dy", "dx"]).groupby("dy")["dx"]}
    first = F.create_map(*[F.lit(v) for y, (a, _) in spans.items() for v in (y, a)])
    last = F.create_map(*[F.lit(v) for y, (_, b) in spans.items() for v in (y, b)])
    y0, x0 = (F.col("y0"), F.col("x0")) if name == "image" else (F.lit(0), F.lit(0))

    def keep(v: Column, y: Column, x: Column) -> Column:
        inside = F.coalesce((x + x0 >= F.element_at(first, (y + y0).cast("int"))) & (x + x0 <= F.element_at(last, (y + y0).cast("int"))), F.lit(False))
        return F.when(~inside if invert else inside, v).otherwise(F.lit(0.0))

    return assay.map(name, lambda d: d.withColumn("px", _by_place("px", keep)))
