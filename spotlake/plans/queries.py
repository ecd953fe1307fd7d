"""A query per operator over the test tables, with the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.functions.columns import natural_key, window_start
from spotlake.model import plane
from spotlake.operators import circles, filters, find, finish, geometry, grid, identify, preprocess, stitch, views
from spotlake.plans import lenses
from spotlake.plans.lenses import CHIP, IMG, IMG0, PIX, RATIOS, ROI, SERIES, SPEC, of
from spotlake.presets import CHIPS
from spotlake.sources import paths, tables, tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def r6(c):
    return F.round(c, 6)


# ---- sources ----

URL_SQL = r"'^http[^/]*://([^/]*?)\.example\.([^/]*?)/([^/]*?)/([^/]*?)$'"


@query(f"""SELECT url AS path, regexp_extract(url, {URL_SQL}, 1) AS assay, regexp_extract(url, {URL_SQL}, 3) AS channel, try_cast(regexp_extract(url, {URL_SQL}, 4) AS INT) AS "row"
  FROM pages WHERE regexp_matches(url, {URL_SQL})""")
def q_path_extract(spark, d):
    rows = of(spark, d, "pages").select(F.col("url").alias("path"))
    return paths.extract(rows, "http*://(assay).example.(tld_assay)/(channel)/(row)").select("path", "assay", "channel", "row")


ORDER_PATH = "concat('/data/', o_orderstatus, '/', {time}, '_', o_orderkey % 5, '_', o_custkey % 7, '.TIF')"


def _order_paths(spark, d):
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400), "yyyyMMdd-HHmmss")
    parts = [F.lit("/data/"), F.col("o_orderstatus"), F.lit("/"), stamp, F.lit("_"), (F.col("o_orderkey") % 5).cast("string"), F.lit("_"), (F.col("o_custkey") % 7).cast("string"), F.lit(".TIF")]
    return of(spark, d, "orders").select("o_orderkey", F.concat(*parts).alias("path"))


@query("""SELECT o_orderkey, o_orderstatus AS channel, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS "time", (o_orderkey % 5)::INT AS "row", (o_custkey % 7)::INT AS col FROM orders""")
def q_path_typed(spark, d):
    return paths.extract(_order_paths(spark, d), "/data/(channel)/(time)_(row)_(col).tif").select("o_orderkey", "channel", "time", "row", "col")


@query("""SELECT o_orderstatus AS channel, arg_max(o_custkey % 7, '/data/' || o_orderstatus || '/' || strftime(to_timestamp(epoch(o_orderdate) + o_orderkey % 86400) AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S')
  || '_' || o_orderkey % 5 || '_' || o_custkey % 7)::INT AS dose FROM orders GROUP BY 1""")
def q_path_attached(spark, d):
    rows = paths.extract(_order_paths(spark, d), "/data/(channel)/(time)_(row)_(dose_channel|int).tif")
    return paths.attached(rows, "dose", "channel")


@query("""SELECT o_orderstatus AS channel, (o_orderkey % 5)::INT AS "row", (o_custkey % 7)::INT AS col, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def q_path_dups(spark, d):
    rows = paths.extract(_order_paths(spark, d), "/data/(channel)/*_(row)_(col).tif")
    return paths.duplicates(rows, ["channel", "row", "col"])


@query("""WITH k AS (SELECT DISTINCT s_name || '-' || (s_suppkey * 37 % 101) AS name FROM supplier)
SELECT name, row_number() OVER (ORDER BY list_aggregate(list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), 'string_agg', ''))::INT AS place FROM k""")
def q_natural_sort(spark, d):
    """Names by natural order, numbered; names of assays are few, and only they are in the one window."""
    names = of(spark, d, "supplier").select(F.concat("s_name", F.lit("-"), (F.col("s_suppkey") * 37 % 101).cast("string")).alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(natural_key(F.col("name")))).alias("place"))


@query("""SELECT event_id, floor((1704164645678 + (value * 1000)::BIGINT) / 1000)::BIGINT AS "time" FROM events""")
def q_plane_times(spark, d):
    planes = of(spark, d, "events").select("event_id", (F.round(F.col("value") * 1000)).cast("bigint").alias("delta_ms"))
    return tiff.plane_times(planes, F.lit("2024-01-02 03:04:05.678 -0800")).select("event_id", "time")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, ((l_orderkey % 4) * 3 + l_partkey % 3) * 7 + l_linenumber - 1 AS at FROM lineitem""")
def q_ravel_index(spark, d):
    at = tiff.ravel([F.col("l_orderkey") % 4, F.col("l_partkey") % 3, F.col("l_linenumber") - 1], [4, 3, 7])
    return of(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", at.alias("at"))


@query("""SELECT (s_suppkey // 10)::INT AS mark_row, (s_suppkey % 10)::INT AS mark_col, s_name AS tag FROM supplier""")
def q_pinlist(spark, d):
    k = F.col("s_suppkey")
    listed = of(spark, d, "supplier").select(F.format_string("(%d, %d)", k % 10 + 1, F.floor(k / 10) + 1).alias("Indices"), F.col("s_name").alias("MutantID"))
    return tables.pins(listed)


@query("""UNPIVOT (SELECT n_name AS ln, n_nationkey / 2.0 AS c0, n_regionkey * 1.5 AS c1, 1.0::DOUBLE AS c2 FROM nation) ON c0, c1, c2 INTO NAME channel VALUE v""")
def q_spectra_long(spark, d):
    wide = of(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") / 2).alias("c0"), (F.col("n_regionkey") * 1.5).alias("c1"), F.lit(1.0).alias("c2"))
    return tables.long_spectra(wide)


# ---- preprocessing ----


@query(f"""WITH {PIX} SELECT channel, (dense_rank() OVER (ORDER BY tile_row, tile_col) - 1)::INT AS time_idx, y, x, v FROM pix""")
def q_standardize(spark, d):
    px = lenses.pix(spark, d).withColumnRenamed("tile_row", "time_idx").withColumnRenamed("tile_col", "plate")
    return preprocess.stacked_time(px, ["plate"]).select("channel", "time_idx", "y", "x", "v")


@query(f"""WITH {PIX} SELECT CASE channel WHEN 'A' THEN 'red' WHEN 'N' THEN 'green' ELSE channel END AS channel, count(*) AS n, sum(v) AS v FROM pix GROUP BY 1""")
def q_rename_labels(spark, d):
    px = lenses.pix(spark, d).withColumn("channel", preprocess.relabelled("channel", {"A": "red", "N": "green"}))
    return px.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query(f"""WITH {IMG} SELECT * FROM img""")
def q_rotate_noop(spark, d):
    return preprocess.rotate(_Only(lenses.img(spark, d)), 0).df


class _Only:
    def __init__(self, df):
        self.df = df


FLAT = "(1 + (y * 3 + x * 5) % 7 / 7.0)"


@query(f"""WITH {PIX}, t AS (SELECT *, greatest(v - 3, 0) AS t, greatest(v - 3, 0) / {FLAT} AS q FROM pix), m AS (SELECT channel, max(t) AS m, max(q) AS n FROM t GROUP BY 1)
SELECT channel, tile_row, tile_col, y, x, floor(coalesce(q * m / nullif(n, 0), 0))::DOUBLE AS v FROM t JOIN m USING (channel)""")
def q_flatfield(spark, d):
    """Each channel is an assay of its own, as maxima are those of an assay."""
    y, x = np.indices((32, 32))
    out = preprocess.flatfield_correct(lenses.assay(spark, d, tiles=lenses.tiles(spark, d, F.col("channel"))), 1 + (y * 3 + x * 5) % 7 / 7.0, 3.0)
    keys = ["channel", "tile_row", "tile_col"]
    return lenses.pixels(out["tiles"], *keys).join(lenses.pix(spark, d), [*keys, "y", "x"], "left_semi")


@query(f"""WITH {PIX}, f(channel, f) AS (VALUES ('A', 2.0), ('default', 0.5)) SELECT p.channel, y, x, v, coalesce(o.f, e.f)::DOUBLE AS f FROM pix p LEFT JOIN f o ON o.channel = p.channel AND o.channel <> 'default'
  LEFT JOIN f e ON e.channel = 'default'""")
def q_field_align(spark, d):
    field = spark.createDataFrame([("A", 2.0), ("default", 0.5)], "channel string, f double")
    return preprocess.align_field(lenses.pix(spark, d), field, "f").select("channel", "y", "x", "v", "f")


@query(f"WITH {IMG} SELECT channel, y, 63 - x AS x, v FROM img")
def q_hflip(spark, d):
    return lenses.pixels(preprocess.horizontal_flip(lenses.assay(spark, d))["image"], "channel").filter("v > 0")


@query(f"WITH {IMG} SELECT channel, 63 - y AS y, x, v FROM img")
def q_vflip(spark, d):
    return lenses.pixels(preprocess.vertical_flip(lenses.assay(spark, d))["image"], "channel").filter("v > 0")


def _spans(r):
    p = pd.DataFrame(geometry.disk(r), columns=["dy", "dx"]).groupby("dy")["dx"].agg(["min", "max"])
    return ", ".join(f"({int(dy)}, {int(a)}, {int(b)})" for dy, a, b in p.itertuples())


@query(f"""WITH {IMG}, s(dy, a, b) AS (VALUES {_spans(20)}) SELECT channel, y, x, CASE WHEN s.dy IS NOT NULL THEN v ELSE 0 END AS v FROM img LEFT JOIN s ON y = 30 + dy AND x BETWEEN 33 + a AND 33 + b""")
def q_circle_mask(spark, d):
    masked = preprocess.circle_mask(lenses.assay(spark, d), 40, (30, 33))["image"]
    return lenses.pixels(masked, "channel").join(lenses.img(spark, d), ["channel", "y", "x"], "left_semi")


@query(f"""WITH {IMG0}, m AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM img0 GROUP BY 1)
SELECT channel, y, x, coalesce(floor(255 * (v - lo) / nullif(hi - lo, 0)), 0)::INT AS u FROM img0 JOIN m USING (channel)""")
def q_to_uint8(spark, d):
    return lenses.on_planes(lenses.image(spark, d), "y int, x int, u int", lambda a: lenses.each_pixel(u=circles.to_uint8(a)))


@query(f"WITH {PIX} SELECT channel, tile_row * 27 + y - 2 AS im_y, tile_col * 27 + x - 2 AS im_x, v FROM pix WHERE y BETWEEN 2 AND 28 AND x BETWEEN 2 AND 28")
def q_stitch(spark, d):
    image = stitch.stitch(lenses.assay(spark, d, tiles=lenses.tiles(spark, d)), overlap=5)["image"]
    return lenses.pixels(image, "channel").filter("v > 0").withColumnsRenamed({"y": "im_y", "x": "im_x"})


# ---- circles ----

#: Weights of the Gaussian and of the Scharr derivatives, for the SQL.
GAUSS_SQL = "(VALUES " + ", ".join(f"({dy}, {dx}, {a * b / 256})" for dy, a in zip(range(-2, 3), (1, 4, 6, 4, 1)) for dx, b in zip(range(-2, 3), (1, 4, 6, 4, 1))) + ")"
SCHARR_SQL = "(VALUES " + ", ".join(f"({dy}, {dx}, {dy * a}, {dx * b})" for dy, b in zip((-1, 0, 1), (3, 10, 3)) for dx, a in zip((-1, 0, 1), (3, 10, 3))) + ")"
#: Beyond the borders lies the mirror image of the pixels next to them.
BESIDE = "JOIN img0 s ON s.channel = t.channel AND s.y = 63 - abs(63 - abs(t.y + dy)) AND s.x = 63 - abs(63 - abs(t.x + dx))"
GRAD = f"g AS (SELECT t.channel, t.y, t.x, sum(s.v * wy) AS gy, sum(s.v * wx) AS gx FROM img0 t CROSS JOIN {SCHARR_SQL} w(dy, dx, wy, wx) {BESIDE} GROUP BY 1, 2, 3)"


@query(f"WITH {IMG0} SELECT t.channel, t.y, t.x, round_even(sum(s.v * w), 0) AS v FROM img0 t CROSS JOIN {GAUSS_SQL} k(dy, dx, w) {BESIDE} GROUP BY 1, 2, 3")
def q_gauss5(spark, d):
    return lenses.on_planes(lenses.image(spark, d), "y int, x int, v double", lambda a: lenses.each_pixel(v=circles.smooth(a)))


@query(f"WITH {IMG0}, {GRAD} SELECT channel, y, x, round(gy, 6)::DOUBLE AS gy, round(gx, 6)::DOUBLE AS gx FROM g")
def q_scharr(spark, d):
    return lenses.on_planes(lenses.image(spark, d), "y int, x int, gy double, gx double", lambda a: lenses.each_pixel(**dict(zip(("gy", "gx"), circles.gradients(a)))))


@query(f"WITH {IMG0}, {GRAD} SELECT channel, round(quantile_cont(sqrt(gy * gy + gx * gx), 0.1), 6) AS low, round(quantile_cont(sqrt(gy * gy + gx * gx), 0.9), 6) AS high FROM g GROUP BY 1")
def q_edge_quantiles(spark, d):
    t = lenses.on_planes(lenses.image(spark, d), "low double, high double", lambda a: {k: [v] for k, v in zip(("low", "high"), circles.thresholds(*circles.gradients(a), 0.1, 0.9))})
    return t.withColumns({"low": r6("low"), "high": r6("high")})


@query(f"""WITH RECURSIVE {IMG0}, {GRAD}, l AS (SELECT channel, y, x, sqrt(gy * gy + gx * gx) AS n, gy, gx, abs(gx) * tan(pi() / 8) AS flat, abs(gx) * tan(3 * pi() / 8) AS steep FROM g),
o AS (SELECT l.*, CASE WHEN abs(gy) < flat THEN 0 WHEN abs(gy) > steep THEN 1 WHEN (gy < 0) = (gx < 0) THEN 2 ELSE 3 END AS way FROM l),
p AS (SELECT o.*, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM o JOIN (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) w(way, dy, dx) ON w.way = o.way
  LEFT JOIN l a ON a.channel = o.channel AND a.y = o.y - dy AND a.x = o.x - dx LEFT JOIN l b ON b.channel = o.channel AND b.y = o.y + dy AND b.x = o.x + dx),
weak AS (SELECT channel, y, x, n FROM p WHERE n > 200 AND n > before AND (n > after OR way < 2 AND n = after)),
kept AS (SELECT channel, y, x FROM weak WHERE n > 500 UNION SELECT v.channel, v.y, v.x FROM kept k JOIN weak v ON v.channel = k.channel AND abs(v.y - k.y) <= 1 AND abs(v.x - k.x) <= 1)
SELECT channel, y, x FROM kept""")
def q_canny(spark, d):
    def edges(a):
        y, x = np.nonzero(circles.canny(*circles.gradients(a), 200.0, 500.0))
        return {"y": y, "x": x}

    return lenses.on_planes(lenses.image(spark, d), "y int, x int", edges)


@query(f"WITH {IMG} SELECT channel, (y // 20)::INT AS cy, (x // 20)::INT AS cx, count(*) AS n FROM img WHERE v >= 40 GROUP BY ALL")
def q_edge_grid(spark, d):
    def cells(a):
        y, x, starts, counts = circles.by_cell(a >= 40, 20)
        return {"cy": y[starts] // 20, "cx": x[starts] // 20, "n": counts}

    return lenses.on_planes(lenses.image(spark, d), "cy int, cx int, n long", cells)


@query("""SELECT p_partkey AS id, round_even(p_partkey % 97 + p_size / 4.0 - 8, 0)::INT AS y, round_even(p_partkey % 89 - p_size / 8.0, 0)::INT AS x, round_even(p_size / 4.0, 0)::INT AS r FROM part
  WHERE p_size / 4.0 BETWEEN 2 AND 10 AND round_even(p_partkey % 97 + p_size / 4.0 - 8, 0) + round_even(p_size / 4.0, 0) >= 0 AND round_even(p_partkey % 97 + p_size / 4.0 - 8, 0) - round_even(p_size / 4.0, 0) < 80
  AND round_even(p_partkey % 89 - p_size / 8.0, 0) + round_even(p_size / 4.0, 0) >= 0 AND round_even(p_partkey % 89 - p_size / 8.0, 0) - round_even(p_size / 4.0, 0) < 80""")
def q_circle_filter(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = of(spark, d, "part").select(k.alias("id"), (k % 97 + s / 4.0 - 8).alias("y"), (k % 89 - s / 8.0).alias("x"), (s / 4.0).alias("r"))

    def run(batches):
        for pdf in batches:
            kept, at = circles.within(pdf[["y", "x", "r"]].to_numpy(dtype=float), 2.0, 10.0, (80, 80))
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "y": kept[:, 0], "x": kept[:, 1], "r": kept[:, 2]})

    return c.mapInPandas(run, "id long, y int, x int, r int")


RING_SQL = "(VALUES " + ", ".join(f"({r}, {int(dy)}, {int(dx)}, {len(geometry.ring(r))})" for r in (3, 4, 5) for dy, dx in geometry.ring(r)) + ")"


def _score_circles(spark, d):
    return of(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 61).cast("int").alias("y"), (F.col("p_partkey") * 7 % 59).cast("int").alias("x"), (3 + F.col("p_size") % 3).cast("int").alias("r"))


@query(f"""WITH {IMG0}, {GRAD}, e AS (SELECT channel, y, x, atan2(gy, gx) AS angle FROM g WHERE gy * gy + gx * gx > 10000),
c AS (SELECT p_partkey AS id, channel, (p_partkey % 61)::INT AS y, (p_partkey * 7 % 59)::INT AS x, 3 + p_size % 3 AS r FROM part CROSS JOIN (SELECT DISTINCT channel FROM img)),
a AS (SELECT channel, id, n, dy, dx, c.y + dy AS y, c.x + dx AS x FROM c JOIN {RING_SQL} o(r, dy, dx, n) USING (r)),
f AS (SELECT channel, id, n, CASE WHEN abs(angle - atan2(dy, dx)) > pi() THEN abs(angle - atan2(dy, dx)) - pi() ELSE abs(angle - atan2(dy, dx)) END AS off FROM a LEFT JOIN e USING (channel, y, x))
SELECT channel, id, round(sum(coalesce(4 * abs(off - pi() / 2) / pi() - 1, 0)) / any_value(n), 6) AS score FROM f GROUP BY channel, id""")
def q_circle_score(spark, d):
    """Circles of the parts in every channel."""

    def run(key: tuple, blocks: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        dy, dx = circles.gradients(plane(blocks))
        found = circles.scores(parts[["y", "x", "r"]].to_numpy(), dy * dy + dx * dx > 10000, np.arctan2(dy, dx))
        return pd.DataFrame({"channel": key[0], "id": parts["id"], "score": found})

    everywhere = _score_circles(spark, d).withColumn("channel", F.explode(F.array(*map(F.lit, lenses.COLOURS))))
    got = lenses.image(spark, d).groupBy("channel").cogroup(everywhere.groupBy("channel")).applyInPandas(run, "channel string, id long, score double")
    return got.withColumn("score", r6("score"))


_RING8 = {tuple(map(int, p)) for p in geometry.ring(8, True)}
TOUCH_SQL = "[" + ", ".join(str(1000 * a + b) for a, b in sorted({(p[0] - q[0], p[1] - q[1]) for p in _RING8 for q in _RING8})) + "]"


def _spread(spark, d):
    return of(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 31 % 509).cast("int").alias("y"), (F.col("p_partkey") * 17 % 503).cast("int").alias("x"))


@query(f"""WITH RECURSIVE c AS (SELECT p_brand AS plane, p_partkey AS id, (p_partkey * 31 % 509)::INT AS y, (p_partkey * 17 % 503)::INT AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
g(plane, k, id, fine, chosen) AS (SELECT plane, k, id, true, [{{'y': y, 'x': x}}] FROM c WHERE k = 1 UNION ALL
  SELECT plane, k, id, fine, CASE WHEN fine THEN list_append(chosen, {{'y': y, 'x': x}}) ELSE chosen END FROM (
    SELECT c.plane, c.k, c.id, c.y, c.x, chosen, len(list_filter(chosen, lambda q: list_contains({TOUCH_SQL}, 1000 * (c.y - q.y) + c.x - q.x))) = 0 AS fine FROM g JOIN c ON c.plane = g.plane AND c.k = g.k + 1))
SELECT plane, id FROM g WHERE fine""")
def q_nms(spark, d):
    """The greedy choice itself, per image (here one per brand)."""
    c = _spread(spark, d).join(of(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("plane")), "id")

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        at = circles.greedy(np.column_stack([pdf["y"], pdf["x"], np.full(len(pdf), 8)]), 8, (512, 512))
        return pd.DataFrame({"plane": key[0], "id": pdf["id"].to_numpy()[at]})

    return c.groupBy("plane").applyInPandas(choose, "plane string, id long")


def _drawn(spark, d):
    """An image with a disk at every place of the chip, in blocks of 200 x 200. It is kept on disk, as the finders read it several times."""
    from spotlake.model import SCHEMAS

    marks = lenses.chip(spark, d).select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    h, w = (int(v or 0) + 100 if v is not None else 0 for v in marks.agg(F.max("y"), F.max("x")).first())
    side, across = 200, -(-w // 200)
    met = lambda c: F.sequence(F.floor((F.col(c) - 10) / side), F.floor((F.col(c) + 10) / side))
    on = marks.withColumn("by", F.explode(met("y"))).withColumn("bx", F.explode(met("x"))).groupBy((F.col("by") * across + F.col("bx")).alias("id")).agg(F.collect_list("y").alias("y"), F.collect_list("x").alias("x"))

    def draw(batches):
        for batch in batches:
            for i, ys, xs in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "x"))):
                y0, x0 = side * (i // across), side * (i % across)
                out = np.zeros((min(side, h - y0), min(side, w - x0)))
                for y, x in zip(*(() if v is None else v for v in (ys, xs))):
                    p = geometry.disk(10) + [y - y0, x - x0]
                    p = p[((p >= 0) & (p < out.shape)).all(axis=1)]
                    out[p[:, 0], p[:, 1]] = 1000
                px = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out.ravel()))
                sizes = [pa.array([v], pa.int32()) for v in (0, y0, x0, *out.shape)]
                yield pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["0"]), *sizes, px], names=["assay", "channel", "time_idx", "y0", "x0", "height", "width", "px"])

    n = -(-h // side) * across
    each = spark.range(n).join(on, "id", "left").repartition(max(1, -(-n // 64)), "id")  # a number, as lists of places are too small for Spark to spread them
    return each.mapInArrow(draw, SCHEMAS["image"]).persist(StorageLevel.DISK_ONLY)


def _places(found):
    """Where disks were found, to the nearest ten pixels, and whether their radius is that of the disks drawn but for a pixel."""
    near = lambda c: (10 * F.round(F.col(c) / 10)).cast("int").alias(c)
    return [near("y"), near("x"), (F.abs(found["radius"] - 10) <= 1).alias("sized")]


#: Disks are drawn less than five pixels from these places.
PLACES_SQL = "(100 * (mark_row + 1))::INT AS y, (100 * (mark_col + 1))::INT AS x"


@query(f"WITH {CHIP} SELECT channel, {PLACES_SQL}, true AS sized FROM chip, (VALUES ('0')) c(channel)")
def q_find_circles(spark, d):
    found = find.detect(_drawn(spark, d), low_quantile=0.1, high_quantile=0.9, grid=20, n_iter=5_000_000, min_radius=8, max_radius=12, min_roundness=0.3, min_dist=8)
    return found.select("channel", *_places(found))


# ---- grids ----


@query("""WITH p AS (SELECT DISTINCT c_custkey AS id, c_nationkey % 2 AS ch, (c_custkey * 37 % 1009)::DOUBLE AS y, (c_custkey * 53 % 997)::DOUBLE AS x FROM customer)
SELECT id, y, x FROM p WHERE ch = 0 UNION ALL SELECT id, y, x FROM p WHERE ch = 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.ch = 0 AND (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= 400)""")
def q_point_merge(spark, d):
    p = of(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).cast("string").alias("channel"), (F.col("c_custkey") * 37 % 1009).cast("double").alias("y"), (F.col("c_custkey") * 53 % 997).cast("double").alias("x"))
    return grid.merge_points(p, ["0", "1"], 20.0).select("id", "y", "x")


@query(f"WITH {CHIP} SELECT mark_row AS label, count(*) FILTER (tag <> '') AS ideal FROM chip GROUP BY 1")
def q_ideal_counts(spark, d):
    return grid.ideal_counts(lenses.chip(spark, d), "mark_row")


@query(f"""WITH {CHIP}, ideal AS (SELECT mark_col AS label, count(*) FILTER (tag <> '') AS ideal FROM chip GROUP BY 1), k AS (SELECT count(*) AS k FROM ideal),
o AS (SELECT unnest(range(0, 1100 - 90 * k)) AS o FROM k),
p AS (SELECT o, floor((x - o) / 90)::INT AS label, (x - (o + (floor((x - o) / 90) + 0.5) * 90)) ** 2 AS e FROM chip, o),
g AS (SELECT o, label, count(*) AS n, avg(e) AS var FROM p, k WHERE label >= 0 AND label < k GROUP BY 1, 2), m AS (SELECT o, max(var) AS worst FROM g GROUP BY 1),
c AS (SELECT o.o, sum(coalesce(var, worst, 0) * sqrt(ideal) + 50 * (ideal - coalesce(n, 0)) ** 2) AS cost FROM o CROSS JOIN ideal LEFT JOIN g ON g.o = o.o AND g.label = ideal.label LEFT JOIN m ON m.o = o.o GROUP BY 1)
SELECT o::INT AS "offset", round(cost, 6) AS cost FROM c ORDER BY round(cost, 6), o LIMIT 1""")
def q_cluster_1d(spark, d):
    chip = lenses.chip(spark, d)
    return grid.cluster_1d(chip.select(F.col("x").alias("p")), grid.ideal_counts(chip, "mark_col"), 1100, 90.0, 50.0)


@query(f"""WITH {CHIP} SELECT mark, CASE WHEN floor((x - 70) / 100) BETWEEN 0 AND 9 AND (x - 70) - 100 * floor((x - 70) / 100) < 60 THEN floor((x - 70) / 100) ELSE -1 END::INT AS label FROM chip""")
def q_label_clusters(spark, d):
    return lenses.chip(spark, d).select("mark", grid.label_clusters(F.col("x"), 70.0, 60.0, 40.0, 10).alias("label"))


LINES = """ideal_{a} AS (SELECT mark_{a} AS label, count(*) FILTER (tag <> '') AS ideal FROM chip GROUP BY 1),
pts_{a} AS (SELECT mark_{a} AS label, {u} AS u, {v} AS v FROM chip WHERE tag <> ''),
fit_{a} AS (SELECT label, count(*) AS n, regr_slope(v, u) AS s, regr_intercept(v, u) AS b0 FROM pts_{a} GROUP BY 1), sl_{a} AS (SELECT coalesce(median(s) FILTER (n > 1), 0) AS slope FROM fit_{a}),
res_{a} AS (SELECT label, count(*) AS n, median(v - slope * u) AS b FROM pts_{a}, sl_{a} GROUP BY 1), tr_{a} AS (SELECT regr_slope(b, label) AS m, regr_intercept(b, label) AS c FROM res_{a}),
line_{a} AS (SELECT i.label, slope, CASE WHEN (SELECT count(*) FROM ideal_{a}) = 1 THEN (SELECT max(b0) FROM fit_{a}) WHEN n IS NULL OR ideal = 0 THEN m * i.label + c ELSE least(n, ideal) / ideal * b + (1 - least(n, ideal) / ideal) * (m * i.label + c) END AS intercept
  FROM ideal_{a} i LEFT JOIN res_{a} r ON r.label = i.label, sl_{a}, tr_{a})"""
ROW_LINES, COL_LINES = LINES.format(a="row", u="x", v="y"), LINES.format(a="col", u="y", v="x")


def _lines(spark, d, axis, u, v):
    chip = lenses.chip(spark, d)
    pts = chip.filter("tag <> ''").select(F.col(axis).alias("label"), F.col(u), F.col(v))
    return grid.lines(pts, grid.ideal_counts(chip, axis), u, v)


@query(f"WITH {CHIP}, {ROW_LINES} SELECT label, round(slope, 6) AS slope, round(intercept, 4) AS intercept FROM line_row")
def q_cluster_regress(spark, d):
    return _lines(spark, d, "mark_row", "x", "y").select("label", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(f"""WITH {CHIP}, {ROW_LINES}, {COL_LINES}, g AS (SELECT r.label AS mark_row, c.label AS mark_col, (r.slope * c.intercept + r.intercept) / (1 - r.slope * c.slope) AS y, c.slope AS s, c.intercept AS b FROM line_row r, line_col c)
SELECT mark_row, mark_col, round(y, 4) AS y, round(y * s + b, 4) AS x FROM g""")
def q_grid_intersect(spark, d):
    g = grid.crossings(_lines(spark, d, "mark_row", "x", "y"), _lines(spark, d, "mark_col", "y", "x"))
    return g.select("mark_row", "mark_col", F.round("y", 4).alias("y"), F.round("x", 4).alias("x"))


# ---- finders, masks, regions, time ----


@query(f"WITH {CHIP} SELECT {PLACES_SQL}, true AS sized, true AS valid FROM chip")
def q_find_beads(spark, d):
    from spotlake.model import Assay, table

    a = Assay({"image": _drawn(spark, d), "dims": table("dims", [("a", "channel", 0, "0", {}), ("a", "time", 0, "0", {})])}, {"name": "a"})
    out = find.find_beads(a, 16, 24)
    return out["marks"].select(*_places(out["marks"]), "valid")


@query(f"WITH {CHIP} SELECT mark, mark_row, mark_col, {PLACES_SQL}, true AS sized, tag, true AS valid FROM chip")
def q_find_buttons(spark, d):
    """Buttons without a tag are not looked for, so they have the largest radius and the places of the grid."""
    from spotlake.model import Assay, table

    chip = lenses.chip(spark, d)
    a = Assay({"image": _drawn(spark, d), "tags": chip.select("mark_row", "mark_col", "tag"), "dims": table("dims", [("a", "channel", 0, "0", {}), ("a", "time", 0, "0", {})])}, {"name": "a"})
    out = find.find_buttons(a, row_dist=100, col_dist=100, min_button_diameter=16, max_button_diameter=32)
    places = [c if i < 2 else (F.when(F.col("tag") == "", F.col("radius") == 16).otherwise(c)).alias("sized") for i, c in enumerate(_places(out["marks"]))]
    return out["marks"].select("mark", "mark_row", "mark_col", *places, "tag", "valid")


@query(f"""WITH o(dy, a, b) AS (VALUES {_spans(30)}), i(dy, a, b) AS (VALUES {_spans(16)}), w AS (SELECT y::INT AS y, x::INT AS x FROM range(72) a(y), range(72) b(x))
SELECT y, x, o.dy IS NOT NULL AND i.dy IS NULL AS bg FROM w LEFT JOIN o ON y - 36 = o.dy AND x - 36 BETWEEN o.a AND o.b LEFT JOIN i ON y - 36 = i.dy AND x - 36 BETWEEN i.a AND i.b""")
def q_annulus(spark, d):
    mark = spark.createDataFrame([("a", 0, 0, 36.0, 36.0, 10.0)], "assay string, mark int, time_idx int, y double, x double, radius double")
    masks = find.annulus_masks(mark, 72, 16, 30, 72, 72).select(F.posexplode("bg").alias("i", "bg"))
    return masks.select(F.floor(F.col("i") / 72).cast("int").alias("y"), (F.col("i") % 72).cast("int").alias("x"), "bg")


@query("""WITH p AS (SELECT l_orderkey * 1000000 + l_partkey * 100 + l_suppkey AS id, min(l_linenumber) % 2 AS ch, (l_orderkey * 37 % 4001)::DOUBLE AS y, (l_partkey * 53 % 3989)::DOUBLE AS x FROM lineitem
  GROUP BY l_orderkey, l_partkey, l_suppkey)
SELECT id FROM p WHERE ch = 0 UNION ALL SELECT id FROM p WHERE ch = 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.ch = 0 AND (q.y - p.y) ** 2 + (q.x - p.x) ** 2 <= 400)""")
def q_bead_dedup(spark, d):
    keys = of(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg((F.min("l_linenumber") % 2).cast("string").alias("channel"))
    p = keys.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("id"), "channel", (F.col("l_orderkey") * 37 % 4001).cast("double").alias("y"), (F.col("l_partkey") * 53 % 3989).cast("double").alias("x"))
    return grid.merge_points(p, ["0", "1"], 20.0).select("id")


@query("""SELECT c_custkey AS id, least(greatest(c_custkey * 7 % 600 - 24, 0), 600 - 49)::INT AS top, least(greatest(c_custkey * 11 % 500 - 24, 0), 500 - 49)::INT AS "left" FROM customer""")
def q_bbox(spark, d):
    y, x = F.col("c_custkey") * 7 % 600, F.col("c_custkey") * 11 % 500
    return of(spark, d, "customer").select(F.col("c_custkey").alias("id"), window_start(y, 49, 600).cast("int").alias("top"), window_start(x, 49, 500).cast("int").alias("left"))


def _beads(spark, d):
    k = F.col("s_suppkey")
    return of(spark, d, "supplier").select(
        F.lit("a").alias("assay"), k.cast("int").alias("mark"), F.lit(0).alias("time_idx"), (6 * F.floor(k / 10) + 2).cast("double").alias("y"), (6 * (k % 10) + 1).cast("double").alias("x"), (3 + k % 2).cast("double").alias("radius")
    )


OWNERS = "s(r, dy, a, b) AS (VALUES " + ", ".join(f"({r}, {x[1:]}" for r in (3, 4) for x in _spans(r).replace("), (", ")|(").split("|")) + """),
own AS (SELECT (6 * (s_suppkey // 10) + 2 + dy)::INT AS y, c::INT AS x, CASE WHEN count(*) = 1 THEN min(s_suppkey) ELSE -2 END::INT AS owner
  FROM supplier JOIN s ON r = 3 + s_suppkey % 2, unnest(range(6 * (s_suppkey % 10) + 1 + a, 6 * (s_suppkey % 10) + 2 + b)) u(c)
  WHERE 6 * (s_suppkey // 10) + 2 + dy BETWEEN 0 AND 699 AND c BETWEEN 0 AND 69 GROUP BY 1, 2)"""

@query(f"WITH {OWNERS} SELECT y, x, owner FROM own")
def q_circle_labels(spark, d):
    return find.owners(_beads(spark, d), 700, 70).select("y", "x", "owner")


@query(f"""WITH {OWNERS}, w AS (SELECT s_suppkey::INT AS mark, least(greatest(6 * (s_suppkey // 10) + 2 - 6, 0), 688) AS top, least(greatest(6 * (s_suppkey % 10) + 1 - 6, 0), 58) AS "left" FROM supplier)
SELECT mark, count(*) FILTER (owner = mark) AS fg, 144 - count(owner) AS bg FROM w LEFT JOIN own ON y BETWEEN top AND top + 11 AND x BETWEEN "left" AND "left" + 11 GROUP BY mark""")
def q_bead_masks(spark, d):
    m = find.bead_masks(_beads(spark, d), 12, 700, 70)
    count = lambda c: F.size(F.filter(c, lambda v: v)).cast("long")
    return m.select("mark", count("fg").alias("fg"), count("bg").alias("bg"))


@query(f"""WITH {IMG}, m AS (SELECT s_suppkey::INT AS mark, (s_suppkey * 13 % 64) AS y0, (s_suppkey * 7 % 64) AS x0 FROM supplier),
w AS (SELECT mark, least(greatest(y0 - 6, 0), 52) AS top, least(greatest(x0 - 6, 0), 52) AS lft FROM m)
SELECT mark, channel, (y - top)::INT AS roi_y, (x - lft)::INT AS roi_x, v FROM w JOIN img ON y BETWEEN top AND top + 11 AND x BETWEEN lft AND lft + 11""")
def q_roi_extract(spark, d):
    k = F.col("s_suppkey")
    marks = of(spark, d, "supplier").select(F.lit("a").alias("assay"), k.cast("int").alias("mark"), F.lit(0).alias("time_idx"), (k * 13 % 64).cast("double").alias("y"), (k * 7 % 64).cast("double").alias("x"))
    rois = find.cut_rois(lenses.image(spark, d), marks, 12, 64, 64)
    px = lenses.pixels(rois.withColumn("width", F.col("side")), "mark", "channel")
    return px.filter("v > 0").withColumnsRenamed({"y": "roi_y", "x": "roi_x"})


@query(f"""WITH {SERIES}, e AS (SELECT DISTINCT mark, t FROM series, range(30) r(t)), j AS (SELECT e.mark, t::INT AS time_idx, x, y FROM e LEFT JOIN series s ON s.mark = e.mark AND s.time_idx = t)
SELECT mark, time_idx, coalesce(last_value(x IGNORE NULLS) OVER b, first_value(x IGNORE NULLS) OVER a) AS x, coalesce(last_value(y IGNORE NULLS) OVER b, first_value(y IGNORE NULLS) OVER a) AS y FROM j
WINDOW b AS (PARTITION BY mark ORDER BY time_idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY mark ORDER BY time_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def q_time_fill(spark, d):
    times = spark.range(30).select(F.col("id").cast("int").alias("time_idx"))
    return grid.fill_times(lenses.series(spark, d), times, ["mark"], ["x", "y"])


#: The midpoint circle of radius 1 to 25, an octant at a time.
MIDPOINT = """octant(r, x, y) AS (SELECT r::INT, 1, -r::INT FROM range(1, 26) u(r) UNION ALL SELECT r, x + 1, CASE WHEN x * x + y * y <= r * r THEN y ELSE y + 1 END FROM octant WHERE x < -y),
ring AS (SELECT DISTINCT r, sy * CASE WHEN f THEN x ELSE y END AS dy, sx * CASE WHEN f THEN y ELSE x END AS dx FROM octant, (VALUES (-1), (1)) a(sy), (VALUES (-1), (1)) b(sx), (VALUES (true), (false)) c(f) WHERE x <= -y
  UNION SELECT r::INT, dy * r::INT, dx * r::INT FROM range(1, 26) u(r), (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) e(dy, dx))"""


@query(f"WITH RECURSIVE {MIDPOINT}, s AS (SELECT r, dy, min(dx) AS a, max(dx) AS b FROM ring GROUP BY 1, 2) SELECT r, dy, unnest(range(a, b + 1))::INT AS dx FROM s")
def q_disk(spark, d):
    return geometry.disk_table(range(1, 26))


@query(f"WITH RECURSIVE {MIDPOINT} SELECT r, dy, dx FROM ring")
def q_ring(spark, d):
    return geometry.ring_table(range(1, 26))


# ---- identification ----


@query(f"""WITH {CHIP}, n AS (SELECT max(mark_row) + 2 AS n FROM chip), g AS (SELECT r::INT AS mark_row, c::INT AS mark_col FROM n, unnest(range(n)) u(r), range(10) b(c))
SELECT mark_row, mark_col, coalesce(tag, '') AS tag FROM g LEFT JOIN chip USING (mark_row, mark_col)""")
def q_identify_buttons(spark, d):
    chip = lenses.chip(spark, d)
    rows = int(chip.agg(F.max("mark_row")).first()[0]) + 2
    return identify.tag_grid(chip.select("mark_row", "mark_col", F.when(F.col("tag") == "", "BLANK").otherwise(F.col("tag")).alias("tag")), (rows, 10))


@query(f"WITH {ROI} SELECT mark, channel, round(avg(v) FILTER (fg) - median(v) FILTER (bg), 6) AS i FROM roi GROUP BY ALL")
def q_mark_intensity(spark, d):
    return identify.intensities(*lenses.regions(spark, d)).select("mark", "channel", r6("i").alias("i"))


WEIGHTS_SQL = "(VALUES " + ", ".join(f"('{c}', '{ln}', {w!r})" for c, ln, w in identify.weights_of(lenses.SPECTRA).itertuples(index=False)) + ")"
VOLS = f"vols AS (SELECT mark, ln, sum(w * i) AS vol FROM spec JOIN {WEIGHTS_SQL} k(channel, ln, w) USING (channel) GROUP BY ALL)"


@query(f"WITH {SPEC}, {VOLS} SELECT mark, ln, round(vol, 6) AS vol FROM vols")
def q_unmix(spark, d):
    return identify.unmix(lenses.spec(spark, d), lenses.SPECTRA, "eu").select("mark", "ln", r6("vol").alias("vol"))


@query(f"WITH {SPEC}, {VOLS} SELECT mark, ln, round(vol / nullif(max(vol) FILTER (ln = 'eu') OVER (PARTITION BY mark), 0), 4) AS ratio FROM vols")
def q_ln_ratio(spark, d):
    return identify.unmix(lenses.spec(spark, d), lenses.SPECTRA, "eu").select("mark", "ln", F.round("ratio", 4).alias("ratio"))


@query(f"""WITH {RATIOS}, n AS (SELECT least(round_even(count(*) / 80.0, 0) + 2, count(*)) AS near FROM ratios),
e AS (SELECT a.mark, row_number() OVER (PARTITION BY a.mark ORDER BY (a.u - b.u) ** 2 + (a.w - b.w) ** 2) AS k, sqrt((a.u - b.u) ** 2 + (a.w - b.w) ** 2) AS dist FROM ratios a, ratios b),
k AS (SELECT mark, dist FROM e, n WHERE k = near), q AS (SELECT quantile_cont(dist, 0.95) AS q FROM k) SELECT mark, dist <= q AS kept FROM k, q""")
def q_knn_trim(spark, d):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mark": pdf["mark"], "kept": identify.trim(pdf[["u", "w"]].to_numpy(), 4)})

    return _of_assay(spark, d, run, "mark int, kept boolean")


def _of_assay(spark, d, run, schema):
    """What run makes of the ratios of all marks, which are those of one assay: few, and in one task."""
    return lenses.ratios(spark, d).groupBy(F.lit("a")).applyInPandas(run, schema)


@query(f"""WITH {RATIOS}, m AS (SELECT min(u) AS lo, max(u) AS hi, (max(u) - min(u)) / 0.9 AS s, count(*) AS total FROM ratios),
grid AS (SELECT i, j, 0.75 * s + i * ((1.25 * s - 0.75 * s) / 99) AS scale, lo + j * ((0.25 * hi + 0.75 * lo - lo) / 99) AS shift FROM m, range(100) a(i), range(100) b(j)),
near AS (SELECT i, j, scale, shift, u, least(greatest(floor((u - shift) / (scale * 0.1) + 0.5), 0), 9) * 0.1 AS code FROM grid, ratios),
c AS (SELECT i, j, any_value(scale) AS scale, any_value(shift) AS shift, count(*) AS n, sum((u - (scale * code + shift)) ** 2) AS d FROM near GROUP BY i, j, code),
cost AS (SELECT i, j, any_value(scale) AS scale, any_value(shift) AS shift, 100 * avg(d / n) + avg((n / total - 0.1) ** 2) AS cost FROM c, m GROUP BY i, j HAVING count(*) = 10)
SELECT round(scale, 6) AS scale, round(shift, 6) AS shift FROM cost ORDER BY cost, i, j LIMIT 1""")
def q_affine_fit(spark, d):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, p = identify.fit_axis(pdf["u"].to_numpy(), np.arange(10) / 10.0)
        return pd.DataFrame({"scale": [round(s, 6)], "shift": [round(p, 6)]})

    return _of_assay(spark, d, run, "scale double, shift double")


CENTRES = "centres AS (SELECT code, median(u) AS cu, median(w) AS cw FROM ratios GROUP BY 1)"


def _mixture(pdf: pd.DataFrame):
    x, own = pdf[["u", "w"]].to_numpy(), pdf["code"].to_numpy()
    return x, *identify.mixture_start(x, own, int(own.max()) + 1)


def _of_classes(codes, means, covs, weights, **more) -> pd.DataFrame:
    own = {"mu": means[:, 0], "mw": means[:, 1], "uu": covs[:, 0, 0], "uw": covs[:, 0, 1], "ww": covs[:, 1, 1], "weight": weights[:-1]}
    return pd.DataFrame({"code": codes, **{k: np.round(v, 6) for k, v in (own | more).items()}})


@query(f"WITH {RATIOS}, {CENTRES} SELECT mark, arg_min(c.code, {{'a': (u - cu) ** 2 + (w - cw) ** 2, 'b': c.code}}) AS nearest FROM ratios, centres c GROUP BY mark")
def q_nearest_code(spark, d):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, codes, means, _, _ = _mixture(pdf)
        return pd.DataFrame({"mark": pdf["mark"], "nearest": np.array(codes)[identify.nearest(x, means)]})

    return _of_assay(spark, d, run, "mark int, nearest int")


START = """s AS (SELECT code, count(*) AS n, median(u) AS mu, median(w) AS mw, covar_samp(u, u) + 1e-10 AS uu, covar_samp(u, w) AS uw, covar_samp(w, w) + 1e-10 AS ww FROM ratios GROUP BY 1),
shared AS (SELECT median(uu) AS uu, median(uw) AS uw, median(ww) AS ww, sum(n + 1) + 1e-10 AS total FROM s),
mix AS (SELECT code, mu, mw, shared.uu, shared.uw, shared.ww, (n + 1) / total AS weight FROM s, shared)"""
CLASSES = "code int, mu double, mw double, uu double, uw double, ww double, weight double"


@query(f"WITH {RATIOS}, {START} SELECT code, round(mu, 6) AS mu, round(mw, 6) AS mw, round(uu, 6) AS uu, round(uw, 6) AS uw, round(ww, 6) AS ww, round(weight, 6) AS weight FROM mix")
def q_gmm_init(spark, d):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, codes, means, covs, weights = _mixture(pdf)
        return _of_classes(codes, means, covs, weights)

    return _of_assay(spark, d, run, CLASSES)


@query(f"""WITH {RATIOS}, {START}, l AS (SELECT mark, u, w, code, ln(weight) - (ww * (u - mu) ** 2 - 2 * uw * (u - mu) * (w - mw) + uu * (w - mw) ** 2) / (2 * (uu * ww - uw * uw)) - 0.5 * ln(uu * ww - uw * uw) - ln(2 * pi()) AS lg
  FROM (SELECT mark, u, w FROM ratios), mix UNION ALL SELECT mark, u, w, NULL, ln(1e-10 / total) - (SELECT ln(max(u) - min(u)) + ln(max(w) - min(w)) FROM ratios) FROM ratios, shared),
e AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY mark)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY mark) AS p FROM e),
m AS (SELECT code, sum(p) AS n, sum(p * u) / sum(p) AS mu, sum(p * w) / sum(p) AS mw, avg(p) AS weight FROM p WHERE code IS NOT NULL GROUP BY 1),
c AS (SELECT code, any_value(n) AS n, any_value(mu) AS mu, any_value(mw) AS mw, any_value(weight) AS weight, sum(p * (u - mu) ** 2) / any_value(n) AS uu, sum(p * (u - mu) * (w - mw)) / any_value(n) AS uw, sum(p * (w - mw) ** 2) / any_value(n) AS ww FROM p JOIN m USING (code) GROUP BY 1),
wide AS (SELECT median(v) / 10 AS wide FROM (SELECT unnest([uu, uw, uw, ww]) AS v FROM c))
SELECT code, round(n, 6) AS n, round(mu, 6) AS mu, round(mw, 6) AS mw, round(uu + wide, 6) AS uu, round(uw, 6) AS uw, round(ww + wide, 6) AS ww, round(weight, 6) AS weight FROM c, wide""")
def q_gmm_step(spark, d):
    """One round of expectation and maximisation."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, codes, means, covs, weights = _mixture(pdf)
        p = identify.responsibilities(x, means, covs, weights, identify.uniform_density(x))
        return _of_classes(codes, *identify.mixture_step(x, p), n=p.sum(axis=0)[:-1])

    return _of_assay(spark, d, run, CLASSES + ", n double")


@query()
def q_identify_mrbles(spark, d):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.array([[i / 10, j / 10] for i in (-1, 1) for j in (-1, 1)])
        return pd.DataFrame({"mark": pdf["mark"], "tag": identify.assign_codes(pdf[["u", "w"]].to_numpy(), codes, ["a", "b", "c", "d"])})

    return _of_assay(spark, d, run, "mark int, tag string")


# ---- filters ----

BOUND = "bnd AS (SELECT channel, sqrt(2) * stddev_samp(bg) AS std FROM med GROUP BY 1)"


@query(f"WITH {ROI}, {BOUND} SELECT mark, coalesce(bool_or(fg - bg > 4 * std), false) AS fine FROM med JOIN bnd USING (channel) GROUP BY 1")
def q_filter_expression(spark, d):
    return filters.expressed(lenses.medians(spark, d)).select("mark", "fine")


@query(f"""WITH {ROI}, {BOUND}, {CHIP}, e AS (SELECT mark, channel, fg - bg < 5 * std AS empty FROM med JOIN bnd USING (channel)), j AS (SELECT e.*, tag, mark_row, max(mark_row) OVER () AS last FROM e JOIN chip USING (mark)),
n AS (SELECT *, lag(tag) OVER w AS pt, lag(empty) OVER w AS pe, lead(tag) OVER w AS nt, lead(empty) OVER w AS ne FROM j WINDOW w AS (PARTITION BY channel ORDER BY mark))
SELECT mark, bool_and(tag = '' OR (coalesce(NOT (mark_row > 0 AND pt = '') OR pe, true) AND coalesce(NOT (mark_row < last AND nt = '') OR ne, true))) AS fine FROM n GROUP BY 1""")
def q_filter_leaky(spark, d):
    marks = lenses.chip(spark, d).select("assay", "mark", "mark_row", "mark_col", "tag")
    return filters.leak_free(lenses.medians(spark, d), marks).select("mark", "fine")


@query(f"WITH {ROI} SELECT a.channel, round(stddev_pop(a.bg - b.bg), 4) AS std FROM med a JOIN med b ON a.channel = b.channel AND a.mark <> b.mark GROUP BY 1")
def q_pairwise_std(spark, d):
    return filters.pairwise_std(lenses.medians(spark, d)).select("channel", F.round("std", 4).alias("std"))


STEP = "CASE WHEN {0} = 0 THEN 1 ELSE sqrt(2) + {0} - 1 END"


@query(f"""WITH RECURSIVE {MIDPOINT}, s AS (SELECT r, dy, min(dx) AS a, max(dx) AS b FROM ring GROUP BY 1, 2),
n AS (SELECT s.r, sum(s.b - s.a + 1) AS area, sum(CASE WHEN t.r IS NULL THEN 0 ELSE {STEP.format('abs(s.a - t.a)')} + {STEP.format('abs(s.b - t.b)')} END + CASE WHEN abs(s.dy) = s.r THEN s.b - s.a ELSE 0 END) AS length
  FROM s LEFT JOIN s t ON t.r = s.r AND t.dy = s.dy + 1 GROUP BY 1),
m AS (SELECT p_partkey::INT AS mark, CASE p_partkey % 3 WHEN 0 THEN area WHEN 1 THEN (1 + p_size % 20) * (1 + p_size % 40) ELSE 1 + p_size % 40 END AS area,
  CASE p_partkey % 3 WHEN 0 THEN length WHEN 1 THEN 2 * (p_size % 20) + 2 * (p_size % 40) ELSE 2 * (p_size % 40) END AS length FROM part LEFT JOIN n ON n.r = 4 + p_size % 20)
SELECT mark, coalesce(4 * pi() * area / nullif(length, 0) ** 2 > 0.75, false) AS fine FROM m""")
def q_filter_nonround(spark, d):
    """Roundness of bars, squares and disks drawn from part sizes."""

    def draw(batches):
        for pdf in batches:
            masks = []
            for k, s in zip(pdf["mark"], pdf["s"]):
                m = np.zeros((64, 64), dtype=bool)
                if k % 3 == 0:
                    m = geometry.disk_mask(64, (32, 32), 4 + int(s) % 20)
                else:
                    m[32 : 33 + (int(s) % 20 if k % 3 == 1 else 0), 8 : 9 + int(s) % 40] = True
                masks.append(m.ravel().tolist())
            yield pd.DataFrame({"assay": "a", "mark": pdf["mark"], "time_idx": 0, "fg": masks})

    drawn = of(spark, d, "part").select(F.col("p_partkey").cast("int").alias("mark"), F.col("p_size").alias("s")).mapInPandas(draw, "assay string, mark int, time_idx int, fg array<boolean>")
    return filters.rounded(drawn, 0.75).select("mark", "fine")


# ---- output ----


@query("""SELECT * FROM (VALUES ('default', 'dims', 4), ('default', 'image', 12), ('regions', 'dims', 4), ('all', 'dims', 4), ('all', 'image', 12), ('all', 'tiles', 12)) t(kind, name, n)""")
def q_drop(spark, d):
    """The tables that are left of an assay with tiles and an image, and their rows."""
    full = lenses.assay(spark, d)
    left = {"default": finish.drop(full), "regions": finish.drop(full, roi_only=True), "all": finish.drop(full, drop_tiles=False)}
    counts = [df.agg(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.count(F.lit(1)).cast("int").alias("n")) for kind, out in left.items() for name, df in out.tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query(f"WITH {IMG0} SELECT y, x, v::DOUBLE AS v FROM img0 WHERE channel = 'A'")
def q_restore(spark, d):
    """One channel, whose array had no such dimension, comes back as an array of two dimensions; arrays are for results that fit the driver."""
    one = lenses.assay(spark, d, image=lenses.image(spark, d).filter("channel = 'A'"))
    one = one.map("dims", lambda dims: dims.filter("dim = 'time' or label = 'A'")).noting(original_dims=("y", "x"))
    out = finish.to_numpy(finish.restore_format(one), "image")
    y, x = np.indices(out.shape)
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": out.ravel()}))


@query(f"WITH {IMG} SELECT channel, (y // 4)::INT AS y, (x // 4)::INT AS x, v FROM img WHERE y % 4 = 0 AND x % 4 = 0")
def q_pyramid(spark, d):
    return views.at_level(lenses.img(spark, d), 2)


@query(f"WITH {OWNERS.replace('CASE WHEN count(*) = 1 THEN min(s_suppkey) ELSE -2 END::INT AS owner', '(max(s_suppkey) + 1)::INT AS label')} SELECT 0 AS time_idx, y, x, label FROM own")
def q_overlay(spark, d):
    marks = _beads(spark, d).withColumn("r", F.col("radius").cast("int"))
    px = marks.join(F.broadcast(geometry.disk_table((3, 4))), "r").select("mark", "time_idx", (F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"))
    return views.overlay(px.filter("y between 0 and 699 and x between 0 and 69"))


@query(f"""WITH {CHIP}, r AS (SELECT tag, mark, (row_number() OVER (PARTITION BY tag ORDER BY mark) - 1)::INT AS grid_row FROM chip), g AS (SELECT DISTINCT a.grid_row, b.tag FROM r a, r b)
SELECT grid_row, tag, mark FROM g LEFT JOIN r USING (grid_row, tag)""")
def q_roishow_grid(spark, d):
    return views.roishow_grid(lenses.chip(spark, d).select("tag", "mark"))


@query(f"""WITH {RATIOS} SELECT code::VARCHAR AS tag, count(*) AS n, round(avg(u), 6) AS mean_x, round(avg(w), 6) AS mean_y, round(covar_samp(u, u), 6) AS cov_xx, round(covar_samp(u, w), 6) AS cov_xy,
  round(covar_samp(w, w), 6) AS cov_yy FROM ratios GROUP BY 1""")
def q_cluster_moments(spark, d):
    m = views.cluster_moments(lenses.ratios(spark, d).withColumn("tag", F.col("code").cast("string")), "u", "w")
    return m.select("tag", "n", *[r6(c).alias(c) for c in ("mean_x", "mean_y", "cov_xx", "cov_xy", "cov_yy")])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {round(a, 6)}::DOUBLE, {round(b, 6)}::DOUBLE)" for k, (a, b) in CHIPS.items()) + ") t(chip_type, row_dist, col_dist)")
def q_chip_types(spark, d):
    return spark.createDataFrame([(k, round(a, 6), round(b, 6)) for k, (a, b) in CHIPS.items()], "chip_type string, row_dist double, col_dist double")


FLAGSHIP = "q_image_profile"


@query(f"""WITH {PIX}, s AS (SELECT channel, tile_row * 27 + y - 2 AS im_y, v FROM pix WHERE y BETWEEN 2 AND 28 AND x BETWEEN 2 AND 28)
SELECT channel, (im_y // 9)::INT AS band, count(*) AS n, sum(v) AS total, max(v) AS top FROM s GROUP BY ALL""")
def q_image_profile(spark, d):
    """Tiles stitched and summed by bands of rows: scan, projection, one aggregate."""
    return q_stitch(spark, d).groupBy("channel", F.floor(F.col("im_y") / 9).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("top"))
