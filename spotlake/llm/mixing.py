"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks. A source of weight w releases its block k at slot floor(k / w)
and must have it placed by slot ceil((k + 1) / w); in every slot the released block with the earliest deadline
goes next, which keeps each source within one block of its target at all times. Every document is placed
once: when a source runs out, the weights of the others are scaled up and a new phase begins.

Weights are whole numbers w of a sum H, so after H slots each source has placed w blocks and all begins anew. Such a
period is all that is simulated; the slot of any block follows from it, however many blocks there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from functools import reduce
from math import gcd
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import Scratch, scratch

#: Weights are rounded to whole numbers of about this sum, or of four times the number of sources.
PRECISION = 1000
#: Sources in one schedule. More are dealt into so many groups: one schedule for the groups, one in each between its sources.
GROUP = 256
#: The exponent by which production weights flatten the sizes of sources.
FLATTEN = 0.7
SCHEMA = "doc_id long, source string, block long, slot long, release long, deadline long, position long"


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights above zero as whole numbers, 1 at least."""
    some = {s: w for s, w in weights.items() if w > 0}
    scale = max(PRECISION, 4 * len(some)) / sum(some.values()) if some else 1
    out = {s: max(1, round(w * scale)) for s, w in some.items()}
    common = reduce(gcd, out.values(), 0)
    return {s: w // common for s, w in out.items()}


def period(weights: Mapping[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) for each slot of a period, in which each source places as many blocks as its weight."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # by release
    ready: list[tuple[int, str, int, int]] = []  # by deadline
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))


class Phase(NamedTuple):
    """From slot `first` on: whole periods of `length` slots, then `rest` slots of one. weights and done: of each source, blocks in a period and before the phase."""

    first: int
    length: int
    periods: int
    rest: int
    order: list[tuple[str, int, int, int]]
    weights: dict[str, int]
    done: dict[str, int]
    ends: str


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> Iterator[Phase]:
    """Until one source runs out, then until the next one does. Sources without weight follow at the end, by name."""
    left, done, first = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {min(left): 1}
        length, order = sum(active.values()), []
        periods = min((left[s] - 1) // w for s, w in active.items())
        then = {s: left[s] - periods * w for s, w in active.items()}
        for slot in period(active):
            order.append(slot)
            if slot[0] in then:
                then[slot[0]] -= 1
                if not then[slot[0]]:
                    rest, ends = len(order), slot[0]
                    if not periods:
                        break
                    then = {}
        yield Phase(first, length, periods, rest, order, active, {s: done[s] for s in active}, ends)
        for s, w in active.items():
            placed = periods * w + sum(x[0] == s for x in order[:rest])
            done[s] += placed
            left[s] -= placed
        left = {s: n for s, n in left.items() if n}
        first += periods * length + rest


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple[str, int, int, int]]:
    """(source, block, release, deadline) in order of slots, written out; blocks: how many each source has."""
    out = []
    for p in phases(blocks, weights):
        for n in range(p.periods + 1):
            for s, k, release, deadline in p.order if n < p.periods else p.order[: p.rest]:
                at = p.first + n * p.length
                out.append((s, p.done[s] + n * p.weights[s] + k, at + release, at + deadline))
    return out


SLOTS = "queue string, phase long, r long, pos long, release long, deadline long"
PHASES = "queue string, phase long, done long, w long, first long, length long, start long"


def _tables(sizes: Mapping[str, int], weights: Mapping[str, int], block: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The slots of a period, and where phases begin (start: in rows), for each queue; phases of a queue count from 0."""
    slots, begins, seen, start = [], [], dict.fromkeys(sizes, 0), 0
    for p in phases({s: -(-n // block) for s, n in sizes.items()}, weights):
        own = {s: seen[s] for s in p.weights}
        begins += [(s, own[s], p.done[s], w, p.first, p.length, start) for s, w in p.weights.items()]
        slots += [(s, own[s], k, t, release, deadline) for t, (s, k, release, deadline) in enumerate(p.order)]
        for s in p.weights:
            seen[s] += 1
        # only the source that ends a phase may end with a block that is not full, and it does so in the last slot
        start += (p.periods * p.length + p.rest) * block - -sizes[p.ends] % block
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    return pd.DataFrame(slots, columns=names(SLOTS)), pd.DataFrame(begins, columns=names(PHASES))


def _placed(ranked: DataFrame, slots: DataFrame, begins: DataFrame, block: int) -> DataFrame:
    """ranked (queue, rank, ...) with slot, release, deadline and position in the schedule of the tables."""
    starts = begins.groupBy("queue").agg(F.sort_array(F.collect_list(F.struct("phase", "done", "w", "first", "length", "start"))).alias("phases"))
    rows = ranked.join(starts, "queue").withColumn("b", F.floor(F.col("rank") / F.lit(block)))
    rows = rows.withColumn("p", F.element_at(F.filter("phases", lambda p: p["done"] <= F.col("b")), -1)).drop("phases")
    rows = rows.withColumns({"phase": F.col("p.phase"), "r": (F.col("b") - F.col("p.done")) % F.col("p.w"), "turn": F.floor((F.col("b") - F.col("p.done")) / F.col("p.w")) * F.col("p.length")})
    rows = rows.join(slots, ["queue", "phase", "r"])
    at = F.col("p.first") + F.col("turn")
    position = F.col("p.start") + (F.col("turn") + F.col("pos")) * F.lit(block) + F.col("rank") % F.lit(block)
    new = {"slot": at + F.col("pos"), "release": at + F.col("release"), "deadline": at + F.col("deadline"), "position": position}
    return rows.withColumns(new).drop("p", "phase", "r", "turn", "pos", "b")


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 16, id_col: str = "doc_id", source_col: str = "source", group: int = GROUP, into: Scratch | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, block (its number within the source), slot (of the block), release, deadline, position.

    position numbers all rows from 0 in the mixed order. weights: source -> share; by default the sizes, flattened.
    A null source is the source ``. Sources that weights doesn't name, or not with a share above zero, come last. Above
    `group` sources the schedule has two levels: slot, release and deadline are then those of blocks of groups, a
    source keeps its share of its group within a block, and a group its share of all. Within a source rows go by a hash of
    the id, then by id; a null id goes by its hash too, and rows that repeat an id follow each other. An empty table gives
    no rows. Only the two columns are read, whatever the others' names. The result is a table in `into`.
    """
    spark = docs.sparkSession
    into = into or Scratch(spark)
    with scratch(spark) as own:
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"))
        # rank within the source: rows are range-partitioned and numbered by partition, then shifted by the counts of earlier ones
        keyed = rows.withColumn("h", F.xxhash64("doc_id")).repartitionByRange("source", "h", "doc_id").sortWithinPartitions("source", "h", "doc_id")

        def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part, last, at = TaskContext.get().partitionId(), None, 0
            for pdf in batches:
                rank = pdf.groupby("source", sort=False).cumcount()
                rank[pdf["source"] == last] += at  # rows are sorted, so a source goes on from the batch before
                last, at = pdf["source"].iloc[-1], int(rank.iloc[-1]) + 1
                yield pdf.assign(part=part, local=rank).drop(columns="h")

        numbered = own.stored(keyed.mapInPandas(number, "doc_id long, source string, part int, local long"))
        shares = own.stored(numbered.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")))
        # a partition holds a range, so there are no more rows than sources and partitions together
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = numbered.join(shares.select("source", "part", before.alias("shift")), ["source", "part"]).select("doc_id", "source", (F.col("shift") + F.col("local")).alias("rank"))
        weighed = shares.groupBy("source").agg(F.sum("n").alias("n"))
        if weights is None:
            weighed = weighed.withColumn("weight", F.pow("n", F.lit(FLATTEN)))
        else:
            named = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
            weighed = weighed.join(named, "source", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
        weighed = own.stored(weighed)
        number_of_block = F.floor(F.col("rank") / F.lit(block)).alias("block")
        if weighed.count() > group:
            # those without weight are a group of their own, which has none
            weighed = weighed.withColumn("g", F.when(F.col("weight") > 0, F.pmod(F.xxhash64("source"), F.lit(group))).otherwise(-1))

            def tables(which: int):
                def make(pdf: pd.DataFrame) -> pd.DataFrame:
                    return _tables(dict(zip(pdf["source"], pdf["n"].tolist())), whole(dict(zip(pdf["source"], pdf["weight"]))), block)[which]

                return make

            inner = [own.stored(weighed.groupBy("g").applyInPandas(tables(i), schema)) for i, schema in enumerate((SLOTS, PHASES))]
            within = _placed(ranked.withColumn("queue", F.col("source")), *inner, block).join(weighed.select("source", "g"), "source")
            queues = weighed.groupBy(F.col("g").cast("string").alias("source")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
            ranked = within.select("doc_id", "source", number_of_block, F.col("g").cast("string").alias("queue"), F.col("position").alias("rank"))
        else:
            queues, ranked = weighed, ranked.select("doc_id", "source", number_of_block, F.col("source").alias("queue"), "rank")
        held = queues.collect()  # at most group + 1 rows
        made = _tables({r["source"]: r["n"] for r in held}, whole({r["source"]: r["weight"] for r in held}), block)
        slots, begins = (spark.createDataFrame(pdf, schema) if len(pdf) else spark.createDataFrame([], schema) for pdf, schema in zip(made, (SLOTS, PHASES)))
        # at most max(PRECISION, 4 * group) slots in each of group + 1 phases
        return into.stored(_placed(ranked, F.broadcast(slots), begins, block).select(*[x.split()[0] for x in SCHEMA.split(", ")]))


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 16, position_col: str | None = None, into: Scratch | None = None) -> DataFrame:
    """All rows of docs, with their own columns, dealt out in ranges of the mixed order and sorted by it.

    Files that are read again come in another order, so position_col, if given, names a further column with the position
    (in place of a column of that name); rows that repeat an id in a source share the first of theirs. Null ids and sources
    are placed as mix() says, texts may be null or of any length, columns may have any names, and no rows give none.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    first = mix(docs, weights, block, into=into).groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s")).agg(F.min("position").alias("at"))
    own = [F.col(f"`{c}`") for c in docs.columns if c != position_col]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("id"), source.alias("source"))
    placed = rows.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("source") == F.col("s")), "left").select("row", "at")
    position = [F.col("at").alias(position_col)] if position_col else []
    return placed.repartitionByRange("at").sortWithinPartitions("at").select("row.*", *position)
