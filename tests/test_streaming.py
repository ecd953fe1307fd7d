import numpy as np
from pyspark.sql import functions as F

from spotlake.model import from_numpy
from spotlake.operators.stitch import stitched
from spotlake.streaming.tiles import arriving, focus_watch, stitch_stream


def test_streams_like_batches(spark, tmp_path):
    a = np.random.default_rng(0).random((2, 1, 2, 2, 12, 12))
    tiles = from_numpy(a, ("channel", "time", "row", "col", "y", "x"))["tiles"].withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("tile_row") * 60))
    tiles.write.parquet(str(tmp_path / "in"))
    stream = arriving(spark, str(tmp_path / "in"))
    for name, made, mode in (("blocks", stitch_stream(stream, 4), "append"), ("watch", focus_watch(stream), "complete")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    key = lambda r: (r.channel, r.y0, r.x0, r.px)
    assert sorted(map(key, spark.table("blocks").collect())) == sorted(map(key, stitched(tiles, 4).collect()))
    watch = spark.table("watch").collect()
    assert sum(r.tiles for r in watch) == 8 and len(watch) == 4
    assert abs(max(r.high for r in watch) - a.max()) < 1e-12
