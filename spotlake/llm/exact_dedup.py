"""Exact duplicates by a content sort, in DataFrame operations only.

Rows are range-partitioned at sampled splitters over a short head of the text and its hash, sorted
outside memory so that equal texts become neighbours, and neighbours are compared in full. Keys that
very many rows share are dealt over several ranges; their few run winners meet in a second, small sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys with more than one in HOT_KEYS of all rows (so fewer than HOT_KEYS of them, the bound of the broadcasts below) are split into ranges of about
#: that many rows, or of HOT_FROM if that is more.
HOT_KEYS, HOT_FROM = 10_000, 256


def content_sort(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
    carry: bool = False, hot_from: int = HOT_FROM,
) -> DataFrame:
    """One row per input row: doc_id, body, keep_id, group_size, kept; with carry, also `row`, a struct of all input columns.

    Of rows with equal bodies the one with the largest id stays. A null text counts as empty. A row
    without an id gives way to any row with one; among rows of the same id (or all without) exactly one
    stays. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """

    def body_of(text: Column) -> Column:
        plain = F.coalesce(text, F.lit(""))
        return normalise(plain) if normalise else plain

    said = F.col(f"`{text_col}`")
    moved = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else said.alias("said")
    keyed = docs.select(moved, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.substring(body_of(said), 1, 16).alias("head"), F.xxhash64(body_of(said)).alias("key"))

    size = max(hot_from, docs.count() // HOT_KEYS)
    hot = keyed.groupBy("key").count().filter(F.col("count") >= size).select("key", F.ceil(F.col("count") / size).cast("int").alias("splits"))
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("splits")), F.lit(0)).cast("int"))

    # the body is made again behind the shuffle, so that texts move once
    body = body_of(F.col("row")[text_col] if carry else F.col("said"))
    run = Window.partitionBy("head", "key", "body", "split").orderBy(F.desc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.repartitionByRange("head", "key", "split").withColumn("body", body)
    runs = runs.withColumns({"place": F.row_number().over(run), "run_id": F.first("doc_id").over(whole), "run_size": F.count(F.lit(1)).over(whole)})

    # what the runs of a split text come to: combined before the shuffle, a row for each such text, and texts are compared in full.
    # Rows of one id are in one run, so the first of the run that has the largest id stays.
    second = F.xxhash64("body", F.lit("second")).alias("second")
    split = dealt.filter("splits is not null").select("key", body.alias("body"), "doc_id").groupBy("key", "body").agg(F.max("doc_id").alias("all_id"), F.count(F.lit(1)).alias("all_size"))
    found = runs.withColumn("second", second).join(F.broadcast(split.select("key", second, "all_id", "all_size")), ["key", "second"], "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("run_id")).otherwise(F.col("all_id"))
    kept = (F.col("place") == 1) & F.col("run_id").eqNullSafe(keep_id)
    return found.select(*(["row"] if carry else []), "doc_id", "body", keep_id.alias("keep_id"), F.coalesce("all_size", "run_size").alias("group_size"), kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents."""
    return content_sort(docs).select("doc_id", "keep_id", "group_size", "kept", F.sha2("body", 256).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts (null counts as empty) the row with the largest id, a row without an id only if none has one.

    Of rows that repeat an id one stays; very long texts are compared whole; columns may have any names; no rows give none.
    """
    return content_sort(docs, carry=True).filter("kept").select("row.*")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
