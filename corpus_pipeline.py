"""From raw documents to token ids in five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotlake.llm import byte_bpe, exact_dedup, language_id, minhash, mixing
from spotlake.llm.common import Scratch
from spotlake.llm.queries import tokenizer_path

#: Documents whose language is less sure than this go. The score weighs the learned languages against each other and is at least 0.25
#: with en, de, es and fr; text that reads like none of them goes by its likeness, see language_id.keep_sure.
LEAST_SCORE = 0.2
#: The column that carries the mixed order; the order of rows does not outlast writing and reading files.
POSITION = "mixed_position"


#: Tables that the result of the stage before is read from.
_held: list[Scratch] = []


def _tables(spark: SparkSession) -> Scratch:
    """A folder for the tables of a stage. A stage begins when the result of the one before is written, so what that one still held goes."""
    while _held:
        _held.pop().free()
    _held.append(Scratch(spark))
    return _held[-1]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null or empty ones too), or that read like no language that the model knows, go.

    Repeated rows stay or go together; a very long text is read whole; all columns stay, whatever their names; no rows give none.
    """
    _tables(spark)
    return language_id.keep_sure(docs, LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text the document with the largest id stays; null counts as empty, rows without an id give way, of rows that repeat an id one stays.

    A very long text is compared whole; all columns stay, whatever their names; no rows give none.
    """
    _tables(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, as do all without words or without an id.

    Rows that repeat an id stay or go together; a very long text is read whole; all columns stay, whatever their names; no rows give none.
    """
    return minhash.keep_one(docs, into=_tables(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay and get a position in an order that follows the weights of the sources; a null source is one of its own.

    Null ids go by their hash, rows that repeat an id in a source share a position; texts may be null or of any length; all other
    columns stay, whatever their names; no rows give none.
    """
    return mixing.in_mixed_order(docs, position_col=POSITION, into=_tables(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of ids and of the decoded text, and the position in the mixed order, of every row.

    A null text counts as empty; a null id stays null; a very long text is encoded whole; other columns are not read; no rows give none.
    """
    _tables(spark)
    return byte_bpe.round_trips(docs, tokenizer_path(), position_col=POSITION)


STAGES = [
    ("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("minhash", drop_near_copies), ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned models and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = Scratch(spark)
        docs = written.stored(stage(spark, docs, sf_dir))
        if before:
            before.free()
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
