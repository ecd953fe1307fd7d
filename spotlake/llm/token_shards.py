"""Token ids of documents in training order, as binary shards of records of one size.

Each document becomes sequences of SEQUENCE ids; the last is padded. A document has at most one sequence for SEQUENCE
bytes of its text, so ids and the longest text bound the numbers that sequences can have, and a keyed Feistel
permutation with cycle-walking over all these numbers gives each sequence its place in one global order. Texts are encoded and
moved once: ranges of places are shards, written in order as a stream. The slot of a sequence is the count of those
before it; the manifest tells the first slot of each shard, so slot s lies at a fixed stride from the beginning of its
shard, and a reader can begin anywhere with the files alone.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.byte_bpe import tokenizer
from spotlake.llm.common import Scratch, bounded_batches, scratch, shared_dir
from spotlake.llm.minhash import mix

SEQUENCE, PAD = 512, 0xFFFF
#: Bytes of text for each shard, on average; their number sets the number of shards. Tasks that write them: one each, but no more than this.
SHARD_BYTES, TASKS = 32 << 20, 20_000
#: A record: document, its part, number of ids, and the ids, padded with PAD. A document without an id shows NO_ID.
HEADER = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4")])
NO_ID = -(1 << 63)
#: Records that are read back at once, and shards whose counts the driver holds as one sum.
READ, SHARDS = 4096, 1000


def record_type(sequence: int) -> np.dtype:
    return np.dtype([*[(k, HEADER[k]) for k in HEADER.names], ("ids", "<u2", (sequence,))])


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to x; values outside walk on along their cycle until they are inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key & (2**63 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while True:
        outside = np.flatnonzero(out >= n)
        if not len(outside):
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def shard_of(place: np.ndarray, numbers: int, shards: int) -> np.ndarray:
    """Which of `shards` equal ranges of 0 .. numbers - 1 a place lies in."""
    firsts = np.array([-(-k * numbers // shards) for k in range(shards)], dtype=np.int64)
    return np.searchsorted(firsts, place, side="right") - 1


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Of a folder given by URI or path, for executors and driver alike."""
    return pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{os.path.abspath(folder)}")


def _name(base: str, shard: int) -> str:
    return f"{base}/shard-{shard:08d}.bin"


def read_records(folder: str, shard: int, start: int = 0, count: int | None = None, sequence: int = SEQUENCE) -> np.ndarray:
    """Records start, start + 1, ... of a shard: one seek and one read."""
    fs, base = _filesystem(folder)
    record = record_type(sequence)
    with fs.open_input_file(_name(base, shard)) as f:
        f.seek(start * record.itemsize)
        return np.frombuffer(f.read(None if count is None else count * record.itemsize), dtype=record)


def read_from(folder: str, slot: int, count: int, sequence: int = SEQUENCE) -> np.ndarray:
    """Up to `count` records from a global slot on, by the manifest and the shards alone."""
    fs, base = _filesystem(folder)
    manifest = pq.read_table(f"{base}/manifest", filesystem=fs).sort_by("shard")
    shards, firsts, sizes = (manifest.column(c).to_pylist() for c in ("shard", "first", "count"))
    out = [np.zeros(0, dtype=record_type(sequence))]
    at = max(0, bisect_right(firsts, slot) - 1)
    while count > 0 and at < len(shards):
        start = slot - firsts[at]
        some = min(count, sizes[at] - start)
        if some > 0:
            out.append(read_records(folder, shards[at], start, some, sequence))
            slot, count = slot + some, count - some
        at += 1
    return np.concatenate(out)


def _told(folder: str, shard: int, sequence: int) -> Iterator[pa.RecordBatch]:
    """A row for each record of a shard, read back from its file."""
    start = 0
    while len(data := read_records(folder, shard, start, READ, sequence)):
        ids = pa.array(data["doc_id"], mask=data["doc_id"] == NO_ID)
        checksum = np.array([xxhash.xxh64_intdigest(r["ids"][: r["n"]].tobytes()) for r in data], dtype=np.uint64).view(np.int64)
        shards, places = np.full(len(data), shard, dtype=np.int32), np.arange(start, start + len(data))
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (data["part"], data["n"], shards, places, checksum))], names=["doc_id", "part", "n_tokens", "shard", "place", "checksum"])
        start += len(data)


def _numbered(rows: DataFrame, own: Scratch) -> tuple[DataFrame, int]:
    """rows with `number`, from 0 without gaps: of the distinct ids in order, a null id last. For ids that lie too far apart; moves the texts once more."""
    ids = rows.select("doc_id").distinct().repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"))
    ids = own.stored(ids.select("doc_id", F.monotonically_increasing_id().alias("m")).withColumns({"p": F.shiftright("m", 33), "at": F.col("m").bitwiseAND((1 << 33) - 1)}).drop("m"))
    shares, before = {}, 0
    for r in sorted(ids.groupBy("p").count().collect(), key=lambda r: r["p"]):  # a row for each partition
        shares[r["p"]], before = before, before + r["count"]
    first = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("p"))
    ids = ids.select(F.col("doc_id").alias("known"), (first + F.col("at")).alias("number"))
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("known"))).drop("known"), before


def write_shards(
    docs: DataFrame, path: str, folder: str, own: Scratch, key: int = 20240229, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode docs with the tokenizer file at `path` and write shard-NNNNNNNN.bin into `folder`, shared by all executors.

    Returns, lazily and writing when it is run, a row per sequence: doc_id, part, n_tokens, shard, place (in the shard),
    checksum (64-bit xxHash of its ids as 16-bit little-endian numbers, read back). A file is written under another name and then renamed, so a task that runs again,
    also beside its first attempt, leaves one whole file, and always the same one. A null or empty text has one sequence
    without ids. A null id is shown as NO_ID and told as null. Rows that repeat an id share their places and go by their
    records. Very long texts have many sequences. No rows, no files. Only the two columns are read. Files of one shard are
    about equally long: their numbers of sequences scatter like draws from the permutation.
    """
    bounded_batches(docs.sparkSession)
    if max(tokenizer(path).bytes_of) >= PAD:
        raise ValueError(f"ids must be below {PAD}")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    low, high, longest, total = rows.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-longest // sequence))  # a token has a byte at least
    documents = high - low + 2  # the last number is that of a null id
    if documents * parts < 1 << 62:
        rows = rows.withColumn("number", F.coalesce(F.col("doc_id") - F.lit(low), F.lit(documents - 1)))
    else:
        rows, documents = _numbered(rows, own)
    numbers, shards = max(1, documents * parts), max(1, -(-total // shard_bytes))
    record = record_type(sequence)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            if not ids:
                continue
            of = np.array([max(1, -(-len(x) // sequence)) for x in ids])
            if of.max() > parts:
                raise ValueError("a text has more tokens than bytes")
            out = np.zeros(int(of.sum()), dtype=record)
            out["ids"] = PAD
            out["doc_id"] = np.repeat(batch.column(0).fill_null(NO_ID).to_numpy(), of)
            at = 0
            for x, k in zip(ids, of.tolist()):
                some = out[at : at + k]
                some["part"] = np.arange(k)
                some["n"] = np.minimum(sequence, len(x) - np.arange(k) * sequence)
                flat = np.full(k * sequence, PAD, dtype="<u2")
                flat[: len(x)] = x
                some["ids"] = flat.reshape(k, sequence)
                at += k
            place = feistel(np.repeat(batch.column(2).to_numpy(), of) * parts + out["part"], numbers, key)
            body = pa.Array.from_buffers(pa.binary(record.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(place, numbers, shards).astype(np.int32)), pa.array(place), body], names=["shard", "place", "record"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        shard, stream, other = None, None, ""

        def done() -> Iterator[pa.RecordBatch]:
            stream.close()
            fs.move(other, _name(base, shard))
            yield from _told(folder, shard, sequence)

        try:
            for batch in batches:
                of = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
                for lo, hi in zip(edges, edges[1:]):
                    if of[lo] != shard:
                        if stream:
                            yield from done()
                        shard = int(of[lo])
                        fs.create_dir(base, recursive=True)
                        other = f"{_name(base, shard)}.{uuid.uuid4().hex}"
                        stream = fs.open_output_stream(other)
                    stream.write(b"".join(batch.column(2).slice(lo, hi - lo).to_pylist()))
            if stream:
                yield from done()
        except BaseException:
            if stream and fs.get_file_info(other).type != pafs.FileType.NotFound:
                stream.close()
                fs.delete_file(other)
            raise

    tasks = min(shards, TASKS)
    records = rows.select("doc_id", "text", "number").mapInArrow(encode, "shard int, place long, record binary")
    ranges = records.repartitionById(tasks, F.expr(f"cast(shard * {tasks}L div {shards} as int)")).sortWithinPartitions("shard", "place", "record")
    return ranges.mapInArrow(put, "doc_id long, part int, n_tokens int, shard int, place long, checksum long")


def in_training_order(docs: DataFrame, path: str, folder: str | None = None, into: Scratch | None = None, **options) -> DataFrame:
    """One row per sequence: doc_id, part, n_tokens, slot (global, from 0), shard, offset (bytes in the shard), checksum.

    Writes the shards, by default into a fresh folder under the cluster's shared folder, and beside them `manifest`, a
    Parquet table: shard, first (its first slot), count. Odd rows go as write_shards() says. The result is a table in `into`.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    into = into or Scratch(spark)
    with scratch(spark) as own:
        written = own.stored(write_shards(docs, path, folder, own, **options))
        counts = own.stored(written.groupBy("shard").count().withColumn("g", F.floor(F.col("shard") / SHARDS).cast("long")))
        before, firsts = 0, []
        for r in sorted(counts.groupBy("g").agg(F.sum("count").alias("n")).collect(), key=lambda r: r["g"]):
            firsts.append((r["g"], before))
            before += r["n"]
        within = F.sum("count").over(Window.partitionBy("g").orderBy("shard")) - F.col("count")
        starts = counts.withColumn("within", within).join(F.broadcast(spark.createDataFrame(firsts, "g long, base long")), "g")
        starts = own.stored(starts.select("shard", (F.col("base") + F.col("within")).alias("first"), "count"))
        starts.coalesce(max(1, len(firsts))).write.mode("overwrite").parquet(f"{folder}/manifest")
        size = record_type(options.get("sequence", SEQUENCE)).itemsize
        told = written.join(starts.drop("count"), "shard")
        return into.stored(told.select("doc_id", "part", "n_tokens", (F.col("first") + F.col("place")).alias("slot"), "shard", (F.col("place") * size).alias("offset"), "checksum"))
