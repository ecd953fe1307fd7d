"""Tiles to one image per channel and time: a clip and an affine change of coordinates, row by row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.columns import once
from spotlake.model import Assay
from spotlake.pipeline import component


def check_overlap(overlap: int) -> None:
    if overlap < 0:
        raise ValueError("overlap must not be negative")


def stitched(tiles: DataFrame, overlap: int) -> DataFrame:
    """Image blocks: each tile without overlap // 2 pixels at its leading and the rest of the overlap at its trailing edges."""
    lead = overlap // 2
    h, w = F.col("height") - overlap, F.col("width") - overlap
    fits = F.when((h > 0) & (w > 0), h).otherwise(F.raise_error(F.lit("overlap must be smaller than the tiles")).cast("int"))
    clip = lambda px: F.flatten(F.transform(F.sequence(F.lit(lead), F.lit(lead) + h - 1), lambda y: F.slice(px, y * F.col("width") + lead + 1, w)))
    px = once(F.col("px"), clip) if overlap else F.col("px")
    # clipped first: within a lambda of one select, `width` would be the new one
    return tiles.withColumn("px", px).select(
        "assay", "channel", "time_idx", (F.col("tile_row") * h).cast("int").alias("y0"), (F.col("tile_col") * w).cast("int").alias("x0"), fits.cast("int").alias("height"), w.cast("int").alias("width"),
        "px",
    )


@component("stitch")
def stitch(assay: Assay, overlap: int = 102) -> Assay:
    check_overlap(overlap)
    tiles = assay["tiles"]
    side = tiles.agg(F.min(F.least("height", "width"))).first()[0]
    if side is not None and overlap >= side:
        raise ValueError(f"an overlap of {overlap} pixels leaves nothing of tiles of {side}")
    return assay.with_(image=stitched(tiles, overlap))
