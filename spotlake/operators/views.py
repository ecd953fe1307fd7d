"""Data products behind pictures; drawing them is left to the caller."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.model import Assay

LARGEST = 512 * 512


def levels(height: int, width: int) -> int:
    """How often every second pixel is taken until at most 512 x 512 are left."""
    k = 0
    while -(-height // 2**k) * -(-width // 2**k) > LARGEST:
        k += 1
    return k


def at_level(pixels: DataFrame, level: int) -> DataFrame:
    """Pixels (y, x, ...) of one level of the pyramid, renumbered."""
    step = 2**level
    kept = pixels.filter((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return kept.withColumns({"y": F.floor(F.col("y") / step).cast("int"), "x": F.floor(F.col("x") / step).cast("int")})


def pixels_of(blocks: DataFrame) -> DataFrame:
    """The long form of image blocks: assay, channel, time_idx, y, x, v."""
    long = blocks.select("assay", "channel", "time_idx", "y0", "x0", "width", F.posexplode("px").alias("i", "v"))
    return long.select("assay", "channel", "time_idx", (F.col("y0") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def overlay(fg_pixels: DataFrame) -> DataFrame:
    """(time_idx, y, x, label): mark + 1 of the last mark on each pixel; fg_pixels: mark, time_idx, y, x."""
    return fg_pixels.groupBy("time_idx", "y", "x").agg((F.max("mark") + 1).alias("label"))


def fg_pixels(assay: Assay) -> DataFrame:
    roi = assay["roi"].select("assay", "mark", "time_idx", "top", "left", "side").distinct()
    at = assay["masks"].join(roi, ["assay", "mark", "time_idx"]).select("mark", "time_idx", "top", "left", "side", F.posexplode("fg").alias("i", "on")).filter("on")
    return at.select("mark", "time_idx", (F.col("top") + F.floor(F.col("i") / F.col("side"))).cast("int").alias("y"), (F.col("left") + F.col("i") % F.col("side")).cast("int").alias("x"))


def imshow(assay: Assay) -> dict[str, DataFrame | int]:
    """The pyramid's number of levels, pixels of the coarsest one, the overlay and the boxes of regions."""
    size = assay["image"].agg(F.max(F.col("y0") + F.col("height")), F.max(F.col("x0") + F.col("width"))).first()
    level = levels(int(size[0] or 1), int(size[1] or 1))
    out: dict[str, DataFrame | int] = {"levels": level, "pixels": at_level(pixels_of(assay["image"]), level)}
    if "roi" in assay:
        out |= {"overlay": overlay(fg_pixels(assay)), "boxes": boxes(assay)}
    return out


def boxes(assay: Assay) -> DataFrame:
    """Corners of each region with the tag of its mark."""
    roi = assay["roi"].select("assay", "mark", "time_idx", "top", "left", (F.col("top") + F.col("side")).alias("bottom"), (F.col("left") + F.col("side")).alias("right")).distinct()
    return roi.join(assay["marks"].select("assay", "mark", "time_idx", "tag"), ["assay", "mark", "time_idx"])


def roishow_grid(marks: DataFrame) -> DataFrame:
    """(grid_row, tag, mark): marks of a tag below each other; missing places have no mark."""
    ranked = marks.select("tag", "mark", (F.row_number().over(Window.partitionBy("tag").orderBy("mark")) - 1).alias("grid_row"))
    rows = ranked.select("grid_row").distinct()
    return rows.join(F.broadcast(ranked.select("tag").distinct()), F.lit(True)).join(ranked, ["grid_row", "tag"], "left")


def roishow(assay: Assay) -> DataFrame:
    """Regions with their place in the grid of roishow_grid."""
    first = assay["marks"].filter(F.col("time_idx") == 0)
    return roishow_grid(first.select("tag", "mark")).join(assay["roi"], "mark", "left")


def cluster_moments(points: DataFrame, x: str, y: str) -> DataFrame:
    """tag, n, means and sample covariances of two columns."""
    return points.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.covar_samp(x, x).alias("cov_xx"), F.covar_samp(x, y).alias("cov_xy"), F.covar_samp(y, y).alias("cov_yy")
    )


def ellipses(moments: DataFrame, steps: int = 64, sigmas: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """tag, sigma, x, y: outlines of the normal distributions of moments."""
    half_sum, half_diff = (F.col("cov_xx") + F.col("cov_yy")) / 2, (F.col("cov_xx") - F.col("cov_yy")) / 2
    root = F.sqrt(half_diff**2 + F.col("cov_xy") ** 2)
    turn = F.atan2(2 * F.col("cov_xy"), F.col("cov_xx") - F.col("cov_yy")) / 2
    angle = 2 * np.pi * F.col("k") / steps
    a, b = F.sqrt(half_sum + root) * F.col("sigma") * F.cos(angle), F.sqrt(F.greatest(half_sum - root, F.lit(0.0))) * F.col("sigma") * F.sin(angle)
    spread = moments.withColumn("turn", turn).withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in sigmas]))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))

    def point(u: Column, v: Column) -> tuple[Column, Column]:
        return F.col("mean_x") + u * F.cos("turn") - v * F.sin("turn"), F.col("mean_y") + u * F.sin("turn") + v * F.cos("turn")

    px, py = point(a, b)
    return spread.select("tag", "sigma", px.alias("x"), py.alias("y"))


def mrbles_clusters(assay: Assay, x: str = "dy", y: str = "sm", exclude_outliers: bool = True) -> dict[str, DataFrame]:
    """Ratios of two lanthanides by tag, with moments and ellipses."""
    wide = assay["ln"].groupBy("assay", "mark").pivot("ln", [x, y]).agg(F.first("ratio"))
    points = wide.join(assay["marks"].filter("time_idx = 0").select("assay", "mark", "tag"), ["assay", "mark"])
    if exclude_outliers:
        points = points.filter("tag <> 'outlier'")
    moments = cluster_moments(points, x, y)
    return {"points": points, "moments": moments, "ellipses": ellipses(moments.filter("cov_xx is not null"))}
