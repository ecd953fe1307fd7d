"""Tests of marks. They only ever turn `valid` off."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.model import Assay
from spotlake.operators.identify import masked, median_of
from spotlake.pipeline import component


def contrast(roi: DataFrame, masks: DataFrame) -> DataFrame:
    """assay, mark, channel, fg, bg: medians under the masks at the first time."""
    return masked(roi, masks).select("assay", "mark", "channel", median_of("fg_px").alias("fg"), median_of("bg_px").alias("bg"))


def pairwise_std(of: DataFrame, column: str = "bg", by: Sequence[str] = ("assay", "channel")) -> DataFrame:
    """by, std: the deviation of all differences between two rows; it is the root of 2 times the sample deviation, so no pairs are made."""
    return of.groupBy(*by).agg((F.sqrt(F.lit(2.0)) * F.stddev_samp(column)).alias("std"))


def _in_channels(df: DataFrame, search_channel) -> DataFrame:
    wanted = [search_channel] if isinstance(search_channel, str) else search_channel
    return df.filter(F.col("channel").isin(list(wanted))) if wanted else df


def expressed(medians: DataFrame, min_contrast: float | None = None) -> DataFrame:
    """assay, mark, fine: whether fg - bg is above min_contrast, or above 4 deviations of background differences, in any channel."""
    bound = pairwise_std(medians).select("assay", "channel", (4 * F.col("std")).alias("bound"))
    if min_contrast is not None:
        bound = bound.withColumn("bound", F.lit(float(min_contrast)))
    above = medians.join(F.broadcast(bound), ["assay", "channel"])
    return above.groupBy("assay", "mark").agg(F.coalesce(F.bool_or(F.col("fg") - F.col("bg") > F.col("bound")), F.lit(False)).alias("fine"))


def leak_free(medians: DataFrame, marks: DataFrame, axis: str = "mark") -> DataFrame:
    """assay, mark, fine: whether the blank neighbours of a mark with a tag (one place before and after it) are empty in every channel.

    medians: as of contrast. marks: assay, mark, mark_row, mark_col, tag. Empty is fg - bg below 5 deviations of background differences.
    axis: neighbours in flat order, where the first and the last row have one neighbour each, or along a column with `row`.
    """
    bound = pairwise_std(medians).select("assay", "channel", (5 * F.col("std")).alias("bound"))
    empty = medians.join(F.broadcast(bound), ["assay", "channel"]).withColumn("empty", F.col("fg") - F.col("bg") < F.col("bound"))
    last = marks.groupBy("assay").agg(F.max("mark_row").alias("last"))
    rows = empty.join(marks, ["assay", "mark"]).join(F.broadcast(last), "assay")
    w = Window.partitionBy("assay", "channel", "mark_col").orderBy("mark_row") if axis == "row" else Window.partitionBy("assay", "channel").orderBy("mark")

    def fine(neighbour, there):
        return ~(there & (neighbour("tag") == "")) | neighbour("empty")

    before = fine(lambda c: F.lag(c).over(w), F.col("mark_row") > 0)
    after = fine(lambda c: F.lead(c).over(w), F.col("mark_row") < F.col("last"))
    ok = (F.col("tag") == "") | (F.coalesce(before, F.lit(True)) & F.coalesce(after, F.lit(True)))
    return rows.select("assay", "mark", ok.alias("ok")).groupBy("assay", "mark").agg(F.bool_and("ok").alias("fine"))


def _keeping(assay: Assay, fine: DataFrame) -> Assay:
    marks = assay["marks"]
    joined = marks.join(fine, ["assay", "mark"], "left")
    return assay.with_(marks=joined.withColumn("valid", F.col("valid") & F.coalesce("fine", F.lit(False))).select(*marks.columns))


@component("filter_expression")
def filter_expression(assay: Assay, search_channel: str | Sequence[str] | None = None, min_contrast: float | None = None) -> Assay:
    return _keeping(assay, expressed(_in_channels(contrast(assay["roi"], assay["masks"]), search_channel), min_contrast))


@component("filter_leaky")
def filter_leaky(assay: Assay, search_channel: str | Sequence[str] | None = None, axis: str = "mark") -> Assay:
    marks = assay["marks"].filter(F.col("time_idx") == 0).select("assay", "mark", "mark_row", "mark_col", "tag")
    return _keeping(assay, leak_free(_in_channels(contrast(assay["roi"], assay["masks"]), search_channel), marks, axis))


#: The eight neighbours in order around a pixel.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outer_length(mask: np.ndarray) -> float:
    """Length of the outer borders of the 8-connected parts of a mask, along pixel centres."""
    m = np.pad(mask.astype(bool), 1)
    seen = np.zeros_like(m)
    total = 0.0
    for y, x in zip(*np.nonzero(m)):
        if seen[y, x]:
            continue
        part, todo = set(), [(int(y), int(x))]
        seen[y, x] = True
        while todo:
            p = todo.pop()
            part.add(p)
            for dy, dx in AROUND:
                q = p[0] + dy, p[1] + dx
                if m[q] and not seen[q]:
                    seen[q] = True
                    todo.append(q)
        total += _border(part, (int(y), int(x)))
    return total


def _border(part: set, start: tuple[int, int]) -> float:
    """Walk around the part from its first pixel in reading order, always keeping the outside to the left."""
    at, came, length, first = start, 5, 0.0, None
    while True:
        for turn in range(8):
            k = (came + turn) % 8
            to = at[0] + AROUND[k][0], at[1] + AROUND[k][1]
            if to in part:
                break
        else:
            return 0.0
        if (at, k) == first:
            return length
        first = first or (at, k)
        length += 2**0.5 if k % 2 else 1.0
        at, came = to, (k + 6) % 8 if k % 2 == 0 else (k + 5) % 8


def roundness(mask: np.ndarray) -> float | None:
    """4 pi area / perimeter squared, or None without a perimeter."""
    length = outer_length(mask)
    return 4 * np.pi * float(mask.sum()) / length**2 if length else None


def rounded(masks: DataFrame, min_roundness: float) -> DataFrame:
    """assay, mark, fine: whether the foreground at the first time is round enough."""
    first = masks.agg(F.min("time_idx").alias("time_idx"))

    def run(batches):
        for pdf in batches:
            fine = []
            for fg in pdf["fg"]:
                side = int(len(fg) ** 0.5)
                r = roundness(np.asarray(fg, dtype=bool).reshape(side, side))
                fine.append(r is not None and r > min_roundness)
            yield pd.DataFrame({"assay": pdf["assay"], "mark": pdf["mark"], "fine": fine})

    return masks.join(F.broadcast(first), "time_idx").select("assay", "mark", "fg").mapInPandas(run, "assay string, mark int, fine boolean")


@component("filter_nonround")
def filter_nonround(assay: Assay, min_roundness: float = 0.75, search_channel: str | Sequence[str] | None = None) -> Assay:
    return _keeping(assay, rounded(assay["masks"], min_roundness))
