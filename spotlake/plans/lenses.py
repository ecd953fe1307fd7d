"""The tables of the test data read as pixels, regions, chips, spectra, paths and series; each as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.model import Assay, plane, table
from spotlake.operators.stitch import stitched

#: A made-up set of three spectra over eight channels, and codes over two ratios.
CHANNELS = [f"c{i}" for i in range(8)]
LANTHANIDES = ["eu", "dy", "sm"]
SPECTRA = pd.DataFrame([[((3 * i + 5 * j) % 7 + 1) / 10 for j in range(8)] for i in range(3)], index=LANTHANIDES, columns=CHANNELS)


def of(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pix(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of 2 x 2 tiles of 32 x 32 in three channels: channel, tile_row, tile_col, y, x, v."""
    at = lambda c, n, name: (F.col(c) % n).cast("int").alias(name)
    rows = of(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("channel"), at("l_suppkey", 2, "tile_row"), at("l_linenumber", 2, "tile_col"), at("l_orderkey", 32, "y"), at("l_partkey", 32, "x"), F.col("l_quantity").cast("bigint").alias("q")
    )
    return rows.groupBy("channel", "tile_row", "tile_col", "y", "x").agg(F.sum("q").cast("double").alias("v"))


PIX = """pix AS (SELECT l_returnflag AS channel, (l_suppkey % 2)::INT AS tile_row, (l_linenumber % 2)::INT AS tile_col, (l_orderkey % 32)::INT AS y,
  (l_partkey % 32)::INT AS x, sum(l_quantity::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY ALL)"""


def img(spark: SparkSession, d: str) -> DataFrame:
    """The same stitched without overlap: channel, y, x, v on 64 x 64."""
    return pix(spark, d).select("channel", (F.col("tile_row") * 32 + F.col("y")).alias("y"), (F.col("tile_col") * 32 + F.col("x")).alias("x"), "v")


IMG = PIX + ", img AS (SELECT channel, tile_row * 32 + y AS y, tile_col * 32 + x AS x, v FROM pix)"


#: All pixels of img: those that no row has are 0.
IMG0 = IMG + """, img0 AS (SELECT c.channel, a.y::INT AS y, b.x::INT AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT channel FROM img) c CROSS JOIN range(64) a(y) CROSS JOIN range(64) b(x)
  LEFT JOIN img i ON i.channel = c.channel AND i.y = a.y AND i.x = b.x)"""
COLOURS = ("A", "N", "R")


def tiles(spark: SparkSession, d: str, assay: Column | None = None) -> DataFrame:
    """pix as the table `tiles` of an assay (of one called `a` by default); pixels that no row has are 0."""
    known = pix(spark, d).groupBy("channel", "tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * 32 + F.col("x")).alias("i"), "v"))).alias("known"))
    px = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.coalesce(F.element_at("known", i), F.lit(0.0)))
    size = F.lit(32)
    return known.select(
        (F.lit("a") if assay is None else assay).alias("assay"), "channel", F.lit(0).alias("time_idx"), "tile_row", "tile_col", size.alias("height"), size.alias("width"), F.lit("int64").alias("dtype"), px.alias("px")
    )


def image(spark: SparkSession, d: str) -> DataFrame:
    """img as the table `image`, a block for each tile."""
    return stitched(tiles(spark, d), 0)


def assay(spark: SparkSession, d: str, **tables: DataFrame) -> Assay:
    """tiles and image, or the tables given, with the dimensions that they have."""
    dims = table("dims", [("a", "channel", i, c, {}) for i, c in enumerate(COLOURS)] + [("a", "time", 0, "0", {})])
    return Assay((tables or {"tiles": tiles(spark, d), "image": image(spark, d)}) | {"dims": dims}, {"name": "a"})


def pixels(blocks: DataFrame, *columns: str) -> DataFrame:
    """Blocks or tiles as rows of columns, y, x, v."""
    each = blocks.select("*", F.posexplode("px").alias("i", "v"))
    y, x = F.floor(F.col("i") / F.col("width")).cast("int"), (F.col("i") % F.col("width")).cast("int")
    y0, x0 = (F.col("y0"), F.col("x0")) if "y0" in blocks.columns else (F.lit(0), F.lit(0))
    return each.select(*columns, (y + y0).alias("y"), (x + x0).alias("x"), "v")


def on_planes(image: DataFrame, schema: str, work: Callable[[np.ndarray], Mapping[str, np.ndarray]]) -> DataFrame:
    """channel and the columns of schema: what work makes of each plane of the image."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"channel": key[0], **work(plane(blocks))})

    return image.groupBy("channel").applyInPandas(run, f"channel string, {schema}")


def each_pixel(**planes: np.ndarray) -> dict[str, np.ndarray]:
    y, x = np.indices(next(iter(planes.values())).shape)
    return {"y": y.ravel(), "x": x.ravel()} | {k: v.ravel() for k, v in planes.items()}


def roi(spark: SparkSession, d: str) -> DataFrame:
    """Region pixels: mark, channel, fg, bg, v, with a signal planted in two thirds of the marks."""
    v = F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", 1 + F.col("l_suppkey") % 3).otherwise(1)
    return of(spark, d, "lineitem").select(
        F.lit("a").alias("assay"), F.col("l_suppkey").cast("int").alias("mark"), F.col("l_linestatus").alias("channel"), (F.col("l_returnflag") == "R").alias("fg"),
        (F.col("l_returnflag") == "A").alias("bg"), v.alias("v"), F.col("_metadata.row_index").alias("at"),
    )


ROI = """roi AS (SELECT l_suppkey::INT AS mark, l_linestatus AS channel, l_returnflag = 'R' AS fg, l_returnflag = 'A' AS bg,
  l_extendedprice * CASE WHEN l_returnflag = 'R' THEN 1 + l_suppkey % 3 ELSE 1 END AS v FROM lineitem),
med AS (SELECT mark, channel, median(v) FILTER (fg) AS fg, median(v) FILTER (bg) AS bg FROM roi GROUP BY ALL)"""


def medians(spark: SparkSession, d: str) -> DataFrame:
    return roi(spark, d).groupBy("assay", "mark", "channel").agg(F.median(F.when(F.col("fg"), F.col("v"))).alias("fg"), F.median(F.when(F.col("bg"), F.col("v"))).alias("bg"))


def regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same as the tables `roi` and `masks`: a mark's pixels in one order for all channels, null where they are of another channel.

    The tables are computed apart and a shuffle brings rows in another order each time, so pixels are sorted: as in the file, then by what they hold.
    """
    px = roi(spark, d).groupBy("assay", "mark").agg(F.sort_array(F.collect_list(F.struct("at", "channel", "fg", "bg", "v"))).alias("p")).withColumn("time_idx", F.lit(0))
    of_channel = F.transform("p", lambda p: F.when(p["channel"] == F.col("channel"), p["v"]))
    each = px.withColumn("channel", F.explode(F.array(F.lit("F"), F.lit("O")))).filter(F.exists("p", lambda p: p["channel"] == F.col("channel")))
    rois = each.select("assay", "mark", "channel", "time_idx", F.lit(0).alias("top"), F.lit(0).alias("left"), F.lit(1).alias("side"), of_channel.alias("px"))
    return rois, px.select("assay", "mark", "time_idx", F.col("p.fg").alias("fg"), F.col("p.bg").alias("bg"))


def chip(spark: SparkSession, d: str) -> DataFrame:
    """Buttons on a grid of ten columns with a little jitter: mark, mark_row, mark_col, y, x, tag (some blank)."""
    k, a = F.col("s_suppkey"), F.abs("s_acctbal")
    s = of(spark, d, "supplier").join(F.broadcast(of(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    row, col = F.floor(k / 10).cast("int"), (k % 10).cast("int")
    return s.select(
        F.lit("a").alias("assay"), k.cast("int").alias("mark"), row.alias("mark_row"), col.alias("mark_col"), (100 * (row + 1) + F.floor(a / 7) % 7 - 3).cast("double").alias("y"),
        (100 * (col + 1) + F.floor(a) % 7 - 3).cast("double").alias("x"), F.when(F.col("s_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("tag"),
    )


CHIP = """chip AS (SELECT s_suppkey::INT AS mark, (s_suppkey // 10)::INT AS mark_row, (s_suppkey % 10)::INT AS mark_col,
  (100 * (s_suppkey // 10 + 1) + floor(abs(s_acctbal) / 7)::BIGINT % 7 - 3)::DOUBLE AS y, (100 * (s_suppkey % 10 + 1) + floor(abs(s_acctbal))::BIGINT % 7 - 3)::DOUBLE AS x,
  CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE n_name END AS tag FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def spec(spark: SparkSession, d: str) -> DataFrame:
    """Intensities of marks in eight channels: assay, mark, channel, i."""
    long = of(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("mark"), F.posexplode(F.slice("embedding", 1, 8)).alias("p", "i"))
    return long.select(F.lit("a").alias("assay"), "mark", F.concat(F.lit("c"), F.col("p").cast("string")).alias("channel"), F.col("i").cast("double").alias("i"))


SPEC = """spec AS (SELECT vec_id::INT AS mark, 'c' || (p - 1) AS channel, embedding[p]::DOUBLE AS i FROM embeddings, range(1, 9) r(p))"""


def ratios(spark: SparkSession, d: str) -> DataFrame:
    """Two ratios and a code per mark: mark, u, w, code."""
    e = F.col("embedding")
    return of(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("mark"), e[1].cast("double").alias("u"), e[2].cast("double").alias("w"), F.col("label").alias("code"))


RATIOS = "ratios AS (SELECT vec_id::INT AS mark, embedding[2]::DOUBLE AS u, embedding[3]::DOUBLE AS w, label AS code FROM embeddings)"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Positions of marks on the days on which they have a click: mark, time_idx, x, y; null for marks on days without any position."""
    day = (F.dayofmonth("ts") - 1).cast("int")
    seen = F.col("event_type") == "click"
    return of(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("mark"), day.alias("time_idx")).agg(F.max(F.when(seen, F.col("value"))).alias("x"), F.min(F.when(seen, F.col("value"))).alias("y"))


SERIES = """series AS (SELECT user_id::INT AS mark, (day(ts) - 1)::INT AS time_idx, max(value) FILTER (event_type = 'click') AS x, min(value) FILTER (event_type = 'click') AS y FROM events GROUP BY ALL)"""
