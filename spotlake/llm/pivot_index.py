"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Each label has an inverted list
per pivot; vectors that share enough of their nearest pivots are compared in double precision. A pair
is looked at in the list of the rarest pivot that both share, so it counts once, and a vector can stay out of the lists of its
commonest pivots, in which it would meet only pairs that share too few. The number of pivots grows with the largest label.
Lists that are long all the same are cut into blocks and blocks meet pairwise; a task sees two blocks and returns counts and
a spanning forest of the links in them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.llm.common import Scratch, connected_components, scratch

#: Pivots at least and at most, of which a vector keeps its NEAREST; pairs must share SHARED of them. Blocks hold about BLOCK vectors.
PIVOTS, MOST_PIVOTS, NEAREST, SHARED, BLOCK = 128, 2048, 12, 3, 768
#: There are so many pivots that the lists of the largest label are about this long on average, until MOST_PIVOTS.
LIST = 400
#: Pivots are picked from at most so many vectors.
SAMPLE = 4096


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x in double precision and of length 1; scaled first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit vectors far apart from each other, picked from the rows of sample; if there are too few, some at random."""
    x = unit(sample)
    picked, nearest = [], np.full(len(x), -2.0)
    while len(picked) < min(pivots, len(x)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    more = np.random.default_rng(x.shape[1]).standard_normal((pivots - len(picked), x.shape[1]))
    return np.vstack([x[picked], unit(more)]) if len(more) else x[picked]


def _pivots(classes: DataFrame, fewest: int, nearest: int) -> dict[int, np.ndarray]:
    """Dimension -> its pivots. classes: vec_id, label, v, dim."""
    rows = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("largest"), F.sum("count").alias("n")).collect()  # a row for each dimension
    place, share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)), min(1.0, 2 * SAMPLE / max(1, sum(r["n"] for r in rows)))
    sample = classes.filter(place < int(share * (1 << 30))).orderBy(place, "vec_id").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    return {r["dim"]: choose_pivots(np.array(by_dim.get(r["dim"], [])).reshape(-1, r["dim"]), min(max(fewest, MOST_PIVOTS), max(fewest, r["largest"] * nearest // LIST))) for r in rows}


def _usable(v: Column) -> Column:
    """No null or non-finite component and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """vectors (with `v`, usable) and `near`: the numbers of the nearest pivots of its dimension, nearest first."""
    at_v = vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, flat = batch.column(at_v).offsets.to_numpy(), batch.column(at_v).values.to_numpy()
            sizes = np.diff(begin)
            near: list = [None] * len(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                score = unit(flat[begin[at][:, None] + np.arange(size)]) @ pivots[size].T
                k = min(nearest, score.shape[1])
                top = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1)
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)
                for i, row in zip(at.tolist(), top.tolist()):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))]))


def _compare(shared: int, least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key[2:]
        none = pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
        some = pdf.sort_values("vec_id")
        ids, block, weight = some["vec_id"].to_numpy(), some["block"].to_numpy(), some["w"].to_numpy()
        near = np.vstack(some["near"].to_numpy())  # all of one dimension have as many
        used, place = np.unique(near, return_inverse=True)
        has = np.zeros((len(some), len(used)), dtype=np.float32)
        has[np.arange(len(some))[:, None], place.reshape(near.shape)] = 1
        rarer = int(np.searchsorted(used, pivot))
        at_rarer = has[:, :rarer] @ has[:, :rarer].T > 0  # such pairs belong to the list of a rarer pivot
        pair = (has @ has.T >= min(shared, near.shape[1])) & ~at_rarer
        if i != j:
            pair &= (block[:, None] == i) != (block[None, :] == i)
        np.fill_diagonal(pair, False)
        rows = np.flatnonzero(pair.any(axis=1))
        if not len(rows):
            return none
        x = unit(np.vstack(some["v"].to_numpy()))
        full = np.zeros_like(pair)
        full[rows] = pair[rows] & (x[rows] @ x.T >= least)
        full |= full.T
        if not full.any():
            return none
        count = full @ weight
        root = np.arange(len(some))
        while True:  # least reachable index by label spreading and jumps
            low = np.where(full, root[None, :], len(some)).min(axis=1, initial=len(some))
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(count)
        return pd.DataFrame({"vec_id": ids[at], "links": count[at], "root": ids[root[at]]})

    return run


def near_vectors(
    embeddings: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, into: Scratch | None = None,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, of links with cosine >= least between rows of one label.

    Rows whose label is null, or whose vector is null, empty, zero or not finite throughout, link with nothing; so do
    vectors of different dimensions. Labels are compared in their own type. Equal vectors of one label are compared once
    and link with each other. Rows that repeat a vec_id are one vector that is reported as often as it stands there, with the
    links of the first; a null vec_id links with nothing. An empty table gives no rows. Pivots are fitted on a bounded
    sample (at least `pivots` of them for each dimension); every row is indexed. Other columns are not looked at. The result
    is a table in `into`.
    """
    into = into or Scratch(embeddings.sparkSession)
    kind = embeddings.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType
    exact = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"  # single precision is moved as it is
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast(f"array<{exact}>").alias("v"))
    with scratch(embeddings.sparkSession) as own:
        return into.stored(_linked(rows, least, pivots, nearest, shared, block, own))


def _linked(rows: DataFrame, least: float, pivots: int, nearest: int, shared: int, block: int, own: Scratch) -> DataFrame:
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    # + 0 makes negative zeros equal to zeros; equal vectors form a class, its first vec_id stands for it
    zero = F.lit(0.0).cast(rows.schema["v"].dataType.elementType)
    classed = own.stored(usable.withColumn("v", F.transform("v", lambda x: x + zero)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.*"))
    classes = own.stored(classed.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("w")).select("vec_id", "label", "v", "w", F.size("v").alias("dim")))
    described = own.stored(describe(classes, _pivots(classes, pivots, nearest), nearest))
    # pivots go by how rare they are; at most MOST_PIVOTS rows, or as many as are asked for
    common = {r["p"]: r["n"] for r in described.select(F.explode("near").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = [0] * (max(common, default=-1) + 1)
    for i, p in enumerate(sorted(common, key=lambda p: (common[p], p))):
        rank[p] = i
    ranks = F.lit(rank).cast("array<int>")
    sorted_near = F.array_sort(F.transform("near", lambda p: F.element_at(ranks, p + 1)))
    described = described.withColumn("near", sorted_near)
    entered = F.slice("near", F.lit(1), F.greatest(F.size("near") - shared + 1, F.lit(1)))
    listed = described.withColumn("pivot", F.explode(entered))
    lengths = listed.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # each row goes to all meetings of its block: (i, j) with i <= j
    placed = listed.join(lengths, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    meetings = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "vec_id", "label", "dim", "v", "w", "near", "pivot", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    links = own.stored(meetings.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(_compare(shared, least), "vec_id long, links long, root long"))
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), own)

    verdict = (
        classes.select(F.col("vec_id").alias("first"), "label", "v", "w")
        .join(counts.withColumnRenamed("vec_id", "first"), "first", "left")
        .join(components.withColumnRenamed("node", "first"), "first", "left")
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    )
    of_row = classed.join(verdict, ["label", "v"]).select("vec_id", "n_links", "component_id")
    found = rows.select("vec_id").join(of_row, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, least(vec_id, coalesce(low.y, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
