"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("spotlake")
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def current() -> SparkSession:
    return SparkSession.getActiveSession() or session()


def settled(df: DataFrame) -> DataFrame:
    """df computed once, without the plan that made it: Spark writes out a kept table's whole plan wherever it is used, and again in each table kept after it.

    The rows are in spark.checkpoint.dir, or where that is not set on the executors, which must not be lost then.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
