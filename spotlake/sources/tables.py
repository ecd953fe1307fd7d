"""Tables in files: pin lists, spectra, codes, and whole assays in Parquet."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.model import Assay
from spotlake.session import current


def pins(df: DataFrame) -> DataFrame:
    """mark_row, mark_col, tag from Indices `(column, row)`, counted from 1, and MutantID."""
    at = lambda i: F.regexp_extract("Indices", r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", i).cast("int") - 1
    return df.select(at(2).alias("mark_row"), at(1).alias("mark_col"), F.coalesce("MutantID", F.lit("")).alias("tag"))


def read_pinlist(spark: SparkSession, path: str) -> DataFrame:
    return pins(spark.read.csv(path, header=True))


def long_spectra(df: DataFrame, name: str = "name") -> DataFrame:
    """ln, channel, v from a row per lanthanide and a column per channel."""
    rest = [c for c in df.columns if c != name]
    return df.select(F.col(name), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot(name, rest, "channel", "v").withColumnRenamed(name, "ln")


def read_spectra(path: str) -> pd.DataFrame:
    """Rows lanthanides, columns channels, in the order of the file; spectra and codes are parameters, so small."""
    wide = current().read.csv(path, header=True, inferSchema=True)
    long = long_spectra(wide).toPandas()
    order = [r[0] for r in wide.select("name").collect()]
    return long.pivot(index="ln", columns="channel", values="v").reindex(index=order, columns=[c for c in wide.columns if c != "name"]).rename_axis(index="name", columns=None)


def read_codes(path: str) -> pd.DataFrame:
    """Rows codes, columns lanthanides: a table of the same form."""
    return read_spectra(path)


def save(file: str, assay: Assay) -> None:
    """A folder with a Parquet table for each table of the assay, by assay, and the attributes as JSON."""
    for name, df in assay.tables.items():
        df.write.mode("overwrite").parquet(f"{file}/{name}.parquet")
    attrs = json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in assay.attrs.items()}, default=str)
    current().createDataFrame([(json.dumps(sorted(assay.tables)), attrs)], "tables string, attrs string").coalesce(1).write.mode("overwrite").parquet(f"{file}/assay.parquet")


def load(file: str) -> Assay:
    spark = current()
    names, attrs = spark.read.parquet(f"{file}/assay.parquet").first()
    attrs = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(attrs).items()}
    return Assay({n: spark.read.parquet(f"{file}/{n}.parquet") for n in json.loads(names)}, attrs)
