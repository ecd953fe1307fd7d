"""Finding beads and buttons, and cutting out their regions and masks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.columns import whole, window_start
from spotlake.model import SCHEMAS, Assay, plane, table
from spotlake.operators import wide
from spotlake.operators.circles import find_circles, to_uint8
from spotlake.operators.geometry import disk, disk_mask, window
from spotlake.operators.grid import cluster_1d, crossings, fill_times, ideal_counts, label_clusters, lines, merge_points
from spotlake.pipeline import component
from spotlake.session import settled

CIRCLES = "assay string, channel string, time_idx int, y int, x int, radius int, score double"
#: Marks whose regions one task puts together at a time, and pixels of regions that it puts together in all; at least one mark.
CHUNK, REGIONS = 256, 1 << 22
#: Marks that may be sent to where the blocks are; with more of them, blocks are moved.
FEW = 1_000_000


def as_list(x) -> list:
    return [] if x is None else [x] if isinstance(x, (str, int)) else list(x)


def radii(low: float, high: float) -> tuple[int, int]:
    if low > high:
        raise ValueError("the least diameter must not be above the largest")
    return math.floor(low / 2), math.ceil(high / 2)


def refuse_gui(interactive: bool) -> None:
    if interactive:
        raise NotImplementedError("there is no interactive tuning; set the quantiles and the roundness as parameters")


def detect(image: DataFrame, **options) -> DataFrame:
    """Circles of every plane (assay, channel, time_idx) of the image; one task sees one plane, or one window of a large plane."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        c, s = find_circles(to_uint8(plane(blocks)), **options)
        return pd.DataFrame({"assay": key[0], "channel": key[1], "time_idx": key[2], "y": c[:, 0], "x": c[:, 1], "radius": c[:, 2], "score": s})

    large = [p for p in wide.extents(image).collect() if wide.is_large(p)]
    if not large:
        return image.groupBy("assay", "channel", "time_idx").applyInPandas(run, CIRCLES)
    names = image.sparkSession.createDataFrame([tuple(p[k] for k in wide.KEYS) for p in large], "assay string, channel string, time_idx int")
    small = image.join(F.broadcast(names), wide.KEYS, "left_anti")
    return small.groupBy("assay", "channel", "time_idx").applyInPandas(run, CIRCLES).unionByName(wide.detect(image, large, **options))


def search_channels(assay: Assay, wanted) -> list[str]:
    return as_list(wanted) or [r["label"] for r in assay["dims"].filter("dim = 'channel'").select("idx", "label").distinct().orderBy("idx").collect()]


def image_size(image: DataFrame) -> tuple[int, int]:
    r = image.agg(F.max(F.col("y0") + F.col("height")), F.max(F.col("x0") + F.col("width"))).first()
    return int(r[0] or 0), int(r[1] or 0)


def cut_rois(image: DataFrame, marks: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """The side x side windows of all marks in all channels, from the marks of the same time_idx.

    Windows and blocks meet by equality on the cell of a grid of block size; a block is clipped to the window before rows move on.
    Regions are dealt out by number, as they may be so small when packed that Spark would put all of them into one task.
    """
    cell_y, cell_x, channels = (int(v or 1) for v in image.agg(F.max("height"), F.max("width"), F.count_distinct("channel")).first())
    n, chunk = marks.count(), max(1, min(CHUNK, REGIONS // side**2))
    top, left = window_start(whole(F.col("y")), side, height), window_start(whole(F.col("x")), side, width)
    wanted = marks.select("assay", "mark", "time_idx", top.cast("int").alias("top"), left.cast("int").alias("left"))
    cells = wanted.withColumn("_by", F.explode(F.sequence(F.floor(F.col("top") / cell_y), F.floor((F.col("top") + side - 1) / cell_y)))).withColumn(
        "_bx", F.explode(F.sequence(F.floor(F.col("left") / cell_x), F.floor((F.col("left") + side - 1) / cell_x)))
    )
    blocks = image.withColumns({"_by": F.floor(F.col("y0") / cell_y), "_bx": F.floor(F.col("x0") / cell_x)})
    y1, x1 = F.greatest("top", "y0"), F.greatest("left", "x0")
    y2, x2 = F.least(F.col("top") + side, F.col("y0") + F.col("height")), F.least(F.col("left") + side, F.col("x0") + F.col("width"))
    piece = F.flatten(F.transform(F.sequence(y1 - F.col("y0"), y2 - F.col("y0") - 1), lambda y: F.slice("px", (y * F.col("width") + x1 - F.col("x0") + 1).cast("int"), (x2 - x1).cast("int"))))
    met = (F.broadcast(cells) if n <= FEW else cells.hint("shuffle_hash")).join(blocks, ["assay", "time_idx", "_by", "_bx"]).filter((y2 > y1) & (x2 > x1))
    parts = met.select("assay", "mark", "channel", "time_idx", "top", "left", (y1 - F.col("top")).alias("dy"), (x1 - F.col("left")).alias("dx"), (x2 - x1).alias("w"), piece.alias("px"), F.floor(F.col("mark") / chunk).alias("_chunk"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple, np.ndarray] = {}
        for r in pdf.itertuples():
            roi = out.setdefault((r.assay, r.mark, r.channel, r.time_idx, r.top, r.left), np.zeros((side, side)))
            px = np.asarray(r.px).reshape(-1, r.w)
            roi[r.dy : r.dy + len(px), r.dx : r.dx + r.w] = px
        rows = [(*k, side, v.ravel()) for k, v in out.items()]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMAS["roi"].split(", ")])

    group = ["assay", "channel", "time_idx", "_chunk"]
    return parts.repartition(max(1, math.ceil(n * channels * side**2 / REGIONS)), *group).groupBy(*group).applyInPandas(build, SCHEMAS["roi"])


def owners(marks: DataFrame, height: int, width: int) -> DataFrame:
    """(assay, time_idx, y, x, owner): the mark on whose disk alone a pixel lies, or -2 on several. Pixels on none have no row."""
    sizes = [int(r[0]) for r in marks.select(F.col("radius").cast("int")).distinct().collect()]  # radii of a search: a bounded few
    offsets = table_of_disks(marks, sizes)
    px = marks.withColumn("r", F.col("radius").cast("int")).join(F.broadcast(offsets), "r").select("assay", "time_idx", "mark", (whole(F.col("y")) + F.col("dy")).alias("y"), (whole(F.col("x")) + F.col("dx")).alias("x"))
    inside = px.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return inside.groupBy("assay", "time_idx", "y", "x").agg(F.when(F.count(F.lit(1)) == 1, F.min("mark")).otherwise(-2).alias("owner"))


def table_of_disks(like: DataFrame, sizes: Iterable[int]) -> DataFrame:
    return like.sparkSession.createDataFrame([(r, int(dy), int(dx)) for r in sizes for dy, dx in disk(r)], "r int, dy int, dx int")


def bead_masks(marks: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """fg: pixels that the mark owns alone; bg: pixels on no mark. Pixels on several marks are in neither."""
    labels = owners(marks, height, width)
    top, left = window_start(whole(F.col("y")), side, height), window_start(whole(F.col("x")), side, width)
    wanted = marks.select("assay", "mark", "time_idx", top.cast("int").alias("top"), left.cast("int").alias("left"))
    cells = wanted.withColumn("_cy", F.explode(F.array(F.floor(F.col("top") / side), F.floor(F.col("top") / side) + 1))).withColumn("_cx", F.explode(F.array(F.floor(F.col("left") / side), F.floor(F.col("left") / side) + 1)))
    cut = cells.join(labels.withColumns({"_cy": F.floor(F.col("y") / side), "_cx": F.floor(F.col("x") / side)}), ["assay", "time_idx", "_cy", "_cx"], "left")
    at = (F.col("y") - F.col("top")) * side + F.col("x") - F.col("left")
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + side) & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + side)
    lists = cut.groupBy("assay", "mark", "time_idx").agg(
        F.collect_list(F.when(inside & (F.col("owner") == F.col("mark")), at)).alias("own"), F.collect_list(F.when(inside, at)).alias("taken")
    )

    def build(batches):
        for pdf in batches:
            fg, bg = [], []
            for own, taken in zip(pdf["own"], pdf["taken"]):
                f, b = np.zeros(side * side, dtype=bool), np.ones(side * side, dtype=bool)
                f[np.asarray(own, dtype=np.int64)] = True
                b[np.asarray(taken, dtype=np.int64)] = False
                fg.append(f.tolist())
                bg.append(b.tolist())
            yield pd.DataFrame({"assay": pdf["assay"], "mark": pdf["mark"], "time_idx": pdf["time_idx"], "fg": fg, "bg": bg})

    return lists.mapInPandas(build, SCHEMAS["masks"])


def annulus_masks(marks: DataFrame, side: int, inner: int, outer: int, height: int, width: int) -> DataFrame:
    """fg: the disk of the mark's radius; bg: between the disks of radius inner and outer around it."""

    def build(batches):
        for pdf in batches:
            fg, bg = [], []
            for y, x, r in zip(pdf["y"], pdf["x"], pdf["radius"]):
                y, x = int(np.rint(y)), int(np.rint(x))
                top, left = window(y, x, side, height, width)
                at = y - top, x - left
                fg.append(disk_mask(side, at, int(r)).ravel().tolist())
                bg.append((disk_mask(side, at, outer) & ~disk_mask(side, at, inner)).ravel().tolist())
            yield pd.DataFrame({"assay": pdf["assay"], "mark": pdf["mark"], "time_idx": pdf["time_idx"], "fg": fg, "bg": bg})

    return marks.select("assay", "mark", "time_idx", "y", "x", "radius").mapInPandas(build, SCHEMAS["masks"])


def times_of(assay: Assay) -> DataFrame:
    return assay["image"].select("time_idx").distinct()


def expressions_of(marks: DataFrame, **columns: Column) -> DataFrame:
    """marks in their schema: given columns, else those there, else nulls."""
    kinds = dict(f.split() for f in SCHEMAS["marks"].split(", "))
    return marks.select(*[(columns[c] if c in columns else F.col(c) if c in marks.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


@component("find_beads")
def find_beads(
    assay: Assay, min_bead_diameter: int = 10, max_bead_diameter: int = 50, low_edge_quantile: float = 0.1, high_edge_quantile: float = 0.9, num_iter: int = 5_000_000,
    min_roundness: float = 0.3, roi_length: int | None = None, search_channel: str | Sequence[str] | None = None, interactive: bool = False,
) -> Assay:
    """marks, roi and masks of the round beads in the image at time 0, in any search channel; positions hold for all times."""
    refuse_gui(interactive)
    low, high = radii(min_bead_diameter, max_bead_diameter)
    side = roi_length if roi_length is not None else 2 * max_bead_diameter
    channels = search_channels(assay, search_channel)
    image = assay["image"]
    height, width = image_size(image)
    if side > min(height, width):
        raise ValueError(f"regions of {side} pixels don't fit into an image of {height} x {width}")
    found = detect(
        image.filter((F.col("time_idx") == image.agg(F.min("time_idx")).first()[0]) & F.col("channel").isin(channels)), low_quantile=low_edge_quantile, high_quantile=high_edge_quantile,
        grid=20, n_iter=num_iter, min_radius=low, max_radius=high, min_roundness=min_roundness, min_dist=low,
    ).persist()
    numbered = found.withColumn("id", F.concat_ws(":", "channel", "y", "x", "radius"))
    kept = merge_points(numbered, channels, 2 * low, on=("assay",))
    place = F.create_map(*[v for i, c in enumerate(channels) for v in (F.lit(c), F.lit(i))])
    order = Window.partitionBy("assay").orderBy(F.element_at(place, F.col("channel")), F.desc("score"), "radius", "y", "x")
    first = kept.withColumn("mark", F.row_number().over(order) - 1).persist()
    marks = first.drop("time_idx").join(F.broadcast(times_of(assay)), F.lit(True))
    marks = expressions_of(marks, tag=F.lit(""), valid=F.lit(True))
    return assay.with_(marks=marks, roi=cut_rois(image, marks, side, height, width), masks=bead_masks(marks, side, height, width)).noting(side=side)


def find_centers(points: DataFrame, tags: DataFrame, size: tuple[int, int], row_dist: float, col_dist: float, chamber: int, penalty: float, top: float | None, left: float | None) -> DataFrame:
    """The crossings of a grid laid through points (y, x) of one plane; tags (mark_row, mark_col, tag) says what to expect."""
    labelled = points
    ideals = {}
    for axis, p, dist, known, n in (("mark_row", "y", row_dist, top, size[0]), ("mark_col", "x", col_dist, left, size[1])):
        ideal = ideals[axis] = settled(ideal_counts(tags, axis))
        k = ideal.count()
        if known is None:
            offset = cluster_1d(points.select(F.col(p).cast("double").alias("p")), ideal, n, dist, penalty).select(F.col("offset").alias(f"_{axis}"))
            labelled = labelled.join(F.broadcast(offset), F.lit(True)).withColumn(axis, label_clusters(F.col(p), F.col(f"_{axis}"), dist, 0.0, k)).drop(f"_{axis}")
        else:
            labelled = labelled.withColumn(axis, label_clusters(F.col(p), known, 2.0 * chamber, dist - 2.0 * chamber, k))
    inside = settled(labelled.filter((F.col("mark_row") >= 0) & (F.col("mark_col") >= 0)).select("mark_row", "mark_col", F.col("y").cast("double"), F.col("x").cast("double")))
    rows = lines(inside.withColumnRenamed("mark_row", "label"), ideals["mark_row"], "x", "y")
    columns = lines(inside.withColumnRenamed("mark_col", "label"), ideals["mark_col"], "y", "x")
    return crossings(rows, columns)


def refine(rois: DataFrame, marks: DataFrame, low: int, high: int, low_quantile: float, n_iter: int, roundness: float) -> DataFrame:
    """Better y, x, radius, score of marks from the best circle in their regions, over the channels there; the old ones where none is found."""
    side_quantile = lambda side: 1 - math.pi * low / side**2
    n_iter = max(n_iter, wide.DRAWS * math.ceil(2 * math.pi * high))  # with many marks, circles are not missed

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (a, m, t), g in pdf.groupby(["assay", "mark", "time_idx"]):
            best = None
            for r in g.sort_values("channel").itertuples():
                c, s = find_circles(to_uint8(np.asarray(r.px).reshape(r.side, r.side)), low_quantile, side_quantile(r.side), 20, n_iter, low, high, roundness, 0, seed=int(m))
                if len(c) and (best is None or s[0] > best[3]):
                    best = (float(c[0, 0] + r.top), float(c[0, 1] + r.left), float(c[0, 2]), float(s[0]))
            if best:
                rows.append((a, m, t, *best))
        return pd.DataFrame(rows, columns=["assay", "mark", "time_idx", "y_", "x_", "radius_", "score_"])

    group = ["assay", "time_idx", "_some"]
    dealt = rois.withColumn("_some", F.floor(F.col("mark") / 8)).repartition(max(1, math.ceil(marks.count() / 128)), *group).groupBy(*group)
    better = dealt.applyInPandas(run, "assay string, mark int, time_idx int, y_ double, x_ double, radius_ double, score_ double")
    joined = marks.join(better, ["assay", "mark", "time_idx"], "left")
    return expressions_of(joined, y=F.coalesce("y_", "y"), x=F.coalesce("x_", "x"), radius=F.coalesce("radius_", F.lit(float(high))), score=F.col("score_"))


@component("find_buttons")
def find_buttons(
    assay: Assay, row_dist: float = 375 / 1.61, col_dist: float = 400 / 1.61, min_button_diameter: int = 8, max_button_diameter: int = 30, chamber_diameter: int = 60,
    top_chamber: float | None = None, left_chamber: float | None = None, low_edge_quantile: float = 0.1, high_edge_quantile: float = 0.9, num_iter: int = 5_000_000,
    min_roundness: float = 0.2, cluster_penalty: float = 50, roi_length: int | None = None, progress_bar: bool = False, search_timestep: int | Sequence[int] | None = 0,
    search_channel: str | Sequence[str] | None = None, interactive: bool = False,
) -> Assay:
    """marks, roi and masks of the buttons of a chip, whose tags the marks table of the assay must have.

    At each searched time a grid is laid through the circles found in the search channels, and each button that has a tag is
    looked for again in its own region. Other times take over positions and masks from the searched time before, or the first.
    """
    refuse_gui(interactive)
    low, high = radii(min_button_diameter, max_button_diameter)
    chamber = chamber_diameter // 2
    side = roi_length if roi_length is not None else round(1.2 * chamber_diameter)
    channels = search_channels(assay, search_channel)
    image, tags = assay["image"], assay["tags"]
    height, width = image_size(image)
    times = times_of(assay).orderBy("time_idx").persist()
    every = [r[0] for r in times.collect()]
    searched = sorted({every[i] for i in as_list(search_timestep)} or every[:1])
    n_marks = max(1, tags.count())
    options = dict(low_quantile=low_edge_quantile, high_quantile=high_edge_quantile, grid=20, n_iter=num_iter, min_radius=low, max_radius=high, min_roundness=min_roundness, min_dist=chamber)
    found = detect(image.filter(F.col("time_idx").isin(searched) & F.col("channel").isin(channels)), **options).withColumn("id", F.concat_ws(":", "channel", "y", "x", "radius")).persist()
    name = str(assay.attrs.get("name", ""))
    grids = []
    for t in searched:
        points = merge_points(found.filter(F.col("time_idx") == t), channels, chamber)
        grids.append(find_centers(points, tags, (height, width), row_dist, col_dist, chamber, cluster_penalty, top_chamber, left_chamber).withColumn("time_idx", F.lit(t)))
    centres = grids[0]
    for g in grids[1:]:
        centres = centres.unionByName(g)
    n_cols = int(tags.agg(F.max("mark_col")).first()[0]) + 1
    inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0))
    marks = centres.join(F.broadcast(tags.drop("assay")), ["mark_row", "mark_col"])
    marks = settled(expressions_of(marks, assay=F.lit(name), mark=F.col("mark_row") * n_cols + F.col("mark_col"), valid=F.lit(True), y=inside("y", height), x=inside("x", width)))
    rois = cut_rois(image.filter(F.col("channel").isin(channels)), marks.filter("tag <> ''"), side, height, width)
    found_marks = refine(rois, marks, low, high, low_edge_quantile, max(1, num_iter // n_marks), min_roundness).persist()
    filled = fill_times(found_marks, times, ["assay", "mark"], ["mark_row", "mark_col", "x", "y", "radius", "score", "tag", "valid"])
    filled = expressions_of(filled).persist()
    return assay.with_(marks=filled, roi=cut_rois(image, filled, side, height, width), masks=annulus_masks(filled, side, high, chamber, height, width)).noting(side=side)


def empty_marks() -> DataFrame:
    return table("marks")
