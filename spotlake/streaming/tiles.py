"""Tiles that arrive while an acquisition runs: the same expressions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.model import SCHEMAS
from spotlake.operators.stitch import check_overlap, stitched


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Rows of tiles, with arrived (timestamp), from Parquet files that are put into a folder."""
    schema = f"{SCHEMAS['tiles']}, arrived timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stitch_stream(tiles: DataFrame, overlap: int) -> DataFrame:
    """Image blocks of each tile as it comes; stitching needs no state."""
    check_overlap(overlap)
    return stitched(tiles, overlap)


def focus_watch(tiles: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per window of arrival and channel: tiles, least, mean and largest pixel. State older than `late` is dropped."""
    size = F.size("px")
    sums = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    return (
        tiles.withWatermark("arrived", late)
        .groupBy(F.window("arrived", window).alias("w"), "assay", "channel")
        .agg(F.count(F.lit(1)).alias("tiles"), F.min(F.array_min("px")).alias("low"), (F.sum(sums) / F.sum(size)).alias("mean"), F.max(F.array_max("px")).alias("high"))
        .select("w.start", "assay", "channel", "tiles", "low", "mean", "high")
    )
