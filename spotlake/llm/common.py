"""What the operators share: cutting lineage in shared storage, batch sizes, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh temporary one."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spotlake-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Tables in a folder of their own within the shared folder. free() deletes them; the folder goes at the latest when the driver's JVM ends.

    A table that is written once survives lost executors and costs no recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.folder = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._path)

    def stored(self, df: DataFrame) -> DataFrame:
        """Write df and read it from its files."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Delete all tables; DataFrames that still read them fail from now on."""
        self._files.delete(self._path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are needed within the block only."""
    own = Scratch(spark)
    try:
        yield own
    finally:
        own.free()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: at most `rows` rows. Plans take the bound when they run, so the session keeps it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Of all rows, keys that hold more than one in HOT_SHARE are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows.join(groups, key) without a task that holds a hot key. groups: a row for each key, with the number of its rows in `size`.

    Rows of keys with more than total / HOT_SHARE rows meet a broadcast of at most HOT_SHARE groups where they are; the others are shuffled.
    """
    hot = F.col(size) > max(HOT_SHARE // 10, total // HOT_SHARE)
    columns = [*rows.columns, *[c for c in groups.columns if c not in (key, size)]]
    marked = rows.join(F.broadcast(groups.filter(hot).drop(size).withColumn("met", F.lit(True))), key, "left")
    rest = marked.filter("met is null").select(*rows.columns).join(groups.filter(~hot).drop(size), key)
    return marked.filter("met").select(*columns).unionByName(rest.select(*columns))


#: Edges for each task of connected_components.
EDGES = 100_000


def connected_components(edges: DataFrame, into: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component), a table in `into`: component is the smallest node that `edges` (a, b: long) reach from node.

    Alternates large-star and small-star rewrites of the edge list: each is a grouped minimum (combined
    before the shuffle) and a join. Both sides of a join come from a shuffle of their own, so that adaptive execution splits
    the partition of a hub with very many edges; the edge count never grows, and sets the number of tasks. A round deletes
    the tables of the one before it. Rows with a null end and self-loops say nothing and are dropped; no edges, no rows.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least_of(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).repartition("u")

    held = Scratch(edges.sparkSession)
    now = held.stored(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = mark(now)
    for _ in range(max_rounds if before[0] else 0):
        tasks = -(-before[0] // EDGES)
        then = Scratch(edges.sparkSession)
        # large star: the larger neighbours of every node go under its smallest neighbour, or under itself if that is larger
        both = now.coalesce(tasks).withColumn("e", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).select("e.*")
        large = both.filter("v > u").join(least_of(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = then.stored(large.coalesce(tasks)).coalesce(tasks)
        # small star: every node's smaller neighbours and itself go under the smallest of them
        small = large.join(least_of(large), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = then.stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        held.free()
        held, after = then, mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("connected components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = into.stored(members.unionByName(roots).coalesce(max(1, -(-before[0] // EDGES))))
    held.free()
    return found


def component_of(df: DataFrame, components: DataFrame, node: str, name: str) -> DataFrame:
    """df with a column `name`: the component of its column `node`, which is a component of its own if it is in none."""
    known = components.select(F.col("node").alias(node), F.col("component").alias("known"))
    return df.join(known, node, "left").withColumn(name, F.coalesce("known", node)).drop("known")


def grown(components: DataFrame, edges: DataFrame, into: Scratch) -> DataFrame:
    """The components after further edges (a, b): known ones count as nodes, so only edges between them are followed."""
    with scratch(edges.sparkSession) as own:
        named = component_of(component_of(edges, components, "a", "c_a"), components, "b", "c_b")
        joined = connected_components(named.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), own)
        moved = component_of(components.select("node", F.col("component").alias("was")), joined, "was", "component").select("node", "component")
        return into.stored(moved.unionByName(joined.join(components, "node", "left_anti")))
