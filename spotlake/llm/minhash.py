"""Near-duplicate documents through HyperMinHash sketches, banding, and verification on full shingle sets.

1. Each text becomes its set of hashed word shingles; equal sets form a class that its smallest id stands for.
2. A class gets REGISTERS registers: of the least hash in each bucket, its leading-zero count and ten bits after the
   leading one. For buckets that stay empty the set is hashed and dealt out anew, until each has an element of its own;
   so registers agree with the chance of the similarity, and independently, however small the sets are.
3. Bands of registers are keys; classes that share a key are candidates. They are first compared with the smallest
   class of their bucket only. What that leaves apart within a bucket is then compared in blocks of bounded size.
4. Candidates whose collision-corrected estimate of the Jaccard similarity is far below the threshold go; the others
   are verified on full sets, and links make connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import Scratch, bounded_batches, component_of, connected_components, grown, join_groups, scratch

WORDS = 5
REGISTERS, BAND, MANTISSA = 160, 4, 10
#: Chance that registers of unrelated minima agree, by which the estimate is corrected.
COLLISION = 0.17 / (1 << MANTISSA)
#: Estimates below threshold - SLACK are not verified; 5.8 standard deviations at 160 registers and a similarity of 0.75.
SLACK = 0.2
#: Elements dealt out at once to buckets that are empty.
THROWN = 1600
BLOCK = 256
REMEMBERED = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer than five words, of the whole sequence; empty without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white-space bytes only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < WORDS:
        return mix(np.array([(h * _FACTORS[: len(h)]).sum() + np.uint64(len(h))], dtype=np.uint64))
    n = len(h) - WORDS + 1
    s = h[:n] * _FACTORS[0]
    for j in range(1, WORDS):
        s += h[j : j + n] * _FACTORS[j]
    return np.unique(mix(s))


@lru_cache(1)
def _lows() -> np.ndarray:
    """Least hash of each bucket."""
    return np.array([-(-(k << 64) // REGISTERS) for k in range(REGISTERS)], dtype=np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    """The bucket of each hash: the last one whose least hash it reaches."""
    return np.searchsorted(_lows(), h, side="right") - 1


def _dealt_anew(u: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """For each bucket of `empty` the least hash in the first further round that puts an element of u there."""
    found, missing, first = np.zeros(REGISTERS, dtype=np.uint64), empty, 1
    while len(missing):
        rounds = -(-THROWN // len(u))
        h = mix(u[None, :] ^ mix(np.arange(first, first + rounds, dtype=np.uint64))[:, None])
        h.sort(axis=1)
        backwards = h.reshape(-1)[::-1]  # what is put last is the least of the earliest round
        thrown, got = np.zeros(REGISTERS, dtype=np.uint64), np.zeros(REGISTERS, dtype=bool)
        bucket = _bucket(backwards)
        thrown[bucket], got[bucket] = backwards, True
        now = missing[got[missing]]
        found[now] = thrown[now]
        missing, first = missing[~got[missing]], first + rounds
    return found[empty]


def sketch(u: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of a set of sorted hashes, not empty."""
    low = _lows()
    at = np.searchsorted(u, low)
    least = u[np.minimum(at, len(u) - 1)]
    empty = np.flatnonzero(at >= np.append(at[1:], len(u)))
    if len(empty):
        least[empty] = _dealt_anew(u, empty)
    rest = ((least - low) * np.uint64(REGISTERS)).astype(np.float64)
    part, power = np.frexp(np.maximum(rest, 1.0))
    zeros = np.minimum(64 - np.minimum(power, 64), 62)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for chance agreement."""
    agree = (a == b).mean(axis=1)
    return (agree - COLLISION) / (1 - COLLISION)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the set), digest (16 bytes of the set; null if it is empty), registers (null if empty)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, registers = [], [], []
            for text in batch.column(1).to_pylist():
                u = shingles(text)
                n.append(len(u))
                digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                registers.append(sketch(u).astype("<u2").tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "n", "digest", "registers"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, registers binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, s: the hashes of the set of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id long, s binary")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimate is not far below it, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = estimate(_registers(batch.column(2)), _registers(batch.column(3)))
                at = pa.array(np.flatnonzero(e >= least - SLACK))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(e).take(at)], names=["a", "b", "e"])

    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    sized = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "r_a", "r_b").mapInArrow(run, "a long, b long, e double")


def _linked(x: bytes, y: bytes, per_cent: int) -> bool:
    """100 * intersection >= per_cent * union of two sets of sorted hashes."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < per_cent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= per_cent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= per_cent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(x, y, per_cent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _meetings(rows: DataFrame, columns: list[str], look, schema: str) -> DataFrame:
    """look(table) -> batches, over whole groups (key, i, j) of rows. A task reads its rows sorted by group and holds a group (two blocks) at a time, besides a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            tail = int(np.argmax((key == key[-1]) & (i == i[-1]) & (j == j[-1])))  # the last group may go on
            if tail:
                yield from look(t.slice(0, tail))
            held = t.slice(tail).to_batches()
        if held:
            yield from look(pa.Table.from_batches(held))

    return rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


MEETING = "key long, i int, j int, rep long, component long, n long, block int, band int, registers binary"


def _likely_within(t: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of likely pairs of different components in the groups of t; a pair counts in the first band that it shares."""
    key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
    change = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.concatenate([[0], np.cumsum(change)])
    comp, n, block, band = (t.column(c).to_numpy() for c in ("component", "n", "block", "band"))
    registers = _registers(t.column("registers"))
    for d in range(1, int(np.bincount(group).max())):
        at = np.flatnonzero((group[d:] == group[:-d]) & (comp[d:] != comp[:-d]) & ((i[d:] == j[d:]) | (block[d:] != block[:-d])))
        at = at[np.minimum(n[at], n[at + d]) >= least * np.maximum(n[at], n[at + d])]
        if len(at):
            at = at[estimate(registers[at], registers[at + d]) >= least - SLACK]
        if len(at):
            same = (registers[at] == registers[at + d]).reshape(len(at), REGISTERS // BAND, BAND).all(axis=2)
            at = at[same.argmax(axis=1) == band[at]]
        if len(at):
            yield at, at + d


def _links_across(rows: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between components within the groups of rows (as MEETING).

    First only rows with a likely partner stay, then these get their full sets and pairs are verified where they are:
    pairs that are no links are never written.
    """
    least = per_cent / 100
    columns = [f.split()[0] for f in MEETING.split(", ")]

    def partnered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(t.num_rows, dtype=bool)
        for a, b in _likely_within(t, least):
            keep[a] = keep[b] = True
        yield from t.filter(pa.array(keep)).to_batches()

    def verified(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, s = t.column("rep").to_numpy(), t.column("s").to_pylist()
        for a, b in _likely_within(t, least):
            hit = np.array([_linked(s[x], s[y], per_cent) for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
            if hit.any():
                a, b = rep[a[hit]], rep[b[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    some = _meetings(rows, columns, partnered, MEETING)
    full = some.join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep")
    return _meetings(full, [*columns, "s"], verified, "a long, b long")


def near_duplicates(docs: DataFrame, per_cent: int = 75, id_col: str = "doc_id", text_col: str = "text", into: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach), kept (doc_id is that).

    A null or empty text, or one without words, has no shingles and links with nothing; so does a row without an id,
    whose component is null and which is kept. Rows that repeat an id are one document with all their links; each is
    reported. An empty table gives no rows. Very long texts are read whole. Other columns are not looked at, whatever
    their names. The result is a table in `into`; all others are deleted.
    """
    into = into or Scratch(docs.sparkSession)
    with scratch(docs.sparkSession) as own:
        return into.stored(_verdicts(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), per_cent, own))


def _verdicts(rows: DataFrame, per_cent: int, own: Scratch) -> DataFrame:
    least = per_cent / 100
    sketched = own.stored(sketches(rows))
    classes = own.stored(
        sketched.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    )
    band = 2 * BAND
    keys = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda k: F.xxhash64(k, F.substring(F.col("registers"), k * band + 1, F.lit(band))))).alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = own.stored(join_groups(keys, buckets, "key", "size", classes.count() * (REGISTERS // BAND)).select("key", "band", "rep", "hub"))
    active = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = own.stored(full_sets(rows.join(active.hint("shuffle_hash"), "doc_id", "left_semi")))

    # every class against the smallest of its buckets: the likeliest one first, then the others that are still apart
    stars = own.stored(_likely(members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), classes, least))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b"))
    component = connected_components(_verified(best, sets, per_cent), own)

    rest = component_of(component_of(stars.join(best, ["a", "b"], "left_anti"), component, "a", "c_a"), component, "b", "c_b").filter("c_a <> c_b")
    component = grown(component, _verified(rest, sets, per_cent), own)

    # buckets that still hold several components: all pairs of different ones, block against block
    placed = component_of(members.select("key", "band", "rep"), component, "rep", "component")
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("mains"), F.sum("n").alias("all")).filter("mains < all")
    # the main component's blocks come first and don't meet each other
    mixed = mixed.withColumns({"a": F.ceil(F.col("mains") / BLOCK).cast("int"), "b": F.ceil((F.col("all") - F.col("mains")) / BLOCK).cast("int")}).drop("mains")
    blocks = join_groups(placed, own.stored(mixed), "key", "all", members.count()).withColumn("is_main", F.col("component") == F.col("main"))
    at = F.xxhash64("rep")
    blocks = blocks.withColumn("block", F.when(F.col("is_main"), F.pmod(at, F.col("a"))).otherwise(F.col("a") + F.pmod(at, F.col("b"))).cast("int"))
    others = F.sequence(F.when(F.col("is_main"), F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)
    meetings = blocks.withColumn("other", F.explode(others)).select("key", "band", "rep", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    component = grown(component, _links_across(meetings.join(classes.select("rep", "n", "registers"), "rep"), sets, per_cent), own)

    verdict = component_of(classes.select("digest", "rep"), component, "rep", "found").select("digest", "found")
    # a set of an id that stands for another set as well may be reached through that id alone
    by_id = component.select(F.col("node").alias("doc_id"), F.col("component").alias("by_id"))
    out = sketched.select("doc_id", "n", "digest").join(verdict, "digest", "left").join(by_id, "doc_id", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", "found", "by_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), root.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, per_cent: int = 75, into: Scratch | None = None) -> DataFrame:
    """docs, with its own columns, without the documents that give way to a near-duplicate of a smaller id.

    Documents without words or without an id stay; rows that repeat an id stay or go together. Other columns may have any names.
    """
    gone = near_duplicates(docs, per_cent, into=into).filter("not kept").select(F.col("doc_id").alias("gone id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone["gone id"], "left_anti")
