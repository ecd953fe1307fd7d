"""Scoring texts with a gated recurrent language model written in numpy.

Tokens are lower-cased words and one end per text. The commonest words are symbols of their own, all
others one shared symbol that is followed by a choice among the rest by smoothed counts, so the score
is the log-probability of the complete text. The output softmax is factored into classes. Training is
truncated backpropagation through time: first on a bounded number of texts, then by every partition on
all windows of each of its training texts, whose weights are averaged. Scoring carries the state over the
windows of a text from its beginning to its end. Word counts cover all training texts; those of rare
words are never gathered but joined.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import Scratch, bounded_batches, scratch

#: Words whose counts are broadcast (the bound of the broadcast), and those of them that are symbols.
HEAD, SYMBOLS = 65_536, 1022
HIDDEN, CLASSES, WINDOW = 16, 31, 32
#: Lanes that are trained on side by side: one for so many tokens, within these bounds. The rate of Adam's steps.
LANE_TOKENS, FEWEST, MOST, RATE = 8192, 16, 256, 0.006
OTHER, END = 0, 1  # symbols; the end is the empty word in counts
FIRST_TEXTS = 256
#: Texts and tokens that the averaged pass holds before it trains on them.
HELD_TEXTS, HELD_TOKENS = 16_384, 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learned from: crc32 of the id as text leaves 2 on division by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _exponentials(h: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits h @ w + bias and their exponentials; states lie within -1 and 1, so rows are shifted by their maxima only where weights are so large that it matters."""
    logits = h @ w + bias
    if np.abs(w).sum(axis=0).max() + np.abs(bias).max() > 40:
        logits -= logits.max(axis=1, keepdims=True)
    return logits, np.exp(logits)


class Gru:
    """Weights: inputs `x` (a row of three gates per symbol), recurrence `h`, classes `c`, symbols in classes `o`."""

    def __init__(self, symbols: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.symbols = symbols
        rest = symbols - 2
        n = min(CLASSES, rest)
        self.first = np.concatenate([[0, 1], 2 + np.arange(n) * rest // max(n, 1), [symbols]]).astype(np.int64)  # of each class
        self.class_of = np.repeat(np.arange(n + 2), np.diff(self.first))
        k = n + 2
        self.w = {"x": draw(symbols, 3 * HIDDEN), "h": draw(HIDDEN, 3 * HIDDEN), "c": draw(HIDDEN, k), "cb": np.zeros(k, np.float32), "o": draw(symbols, HIDDEN), "ob": np.zeros(symbols, np.float32)}
        self.w["x"][:, :HIDDEN] += 1.0  # keep the state at first

    def start_from(self, counts: np.ndarray) -> None:
        """Biases from the counts of the symbols."""
        share = (counts + 1.0) / (counts + 1.0).sum()
        of_class = np.bincount(self.class_of, weights=share)
        self.w["cb"][:] = np.log(of_class)
        self.w["ob"][:] = np.log(share / of_class[self.class_of])

    def step(self, symbol: np.ndarray, h: np.ndarray):
        x, r = self.w["x"][symbol], h @ self.w["h"]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
        z, g = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + g * r[:, 2 * HIDDEN :])
        return z * h + (1 - z) * n, (z, g, n, r[:, 2 * HIDDEN :])

    def log_probability(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural logs of target after states h; with grads, also the gradient of their negated sum by h (returned second)."""
        c = self.class_of[target]
        logits, e = _exponentials(h, self.w["c"], self.w["cb"])
        total = e @ np.ones(e.shape[1], e.dtype)
        at = np.arange(len(target))
        out = logits[at, c] - np.log(total)
        if grads is not None:
            p = e / total[:, None]
            p[at, c] -= 1
            grads["c"] += h.T @ p
            grads["cb"] += p.sum(axis=0)
            dh = p @ self.w["c"].T
        # within classes of several symbols: rows in order of their class
        many = np.flatnonzero(np.diff(self.first)[c] > 1)
        order = many[np.argsort(c[many], kind="stable")]
        edges = np.searchsorted(c[order], np.arange(len(self.first)))
        inside, hs, ts = np.empty(len(order), out.dtype), h[order], target[order]
        below = np.empty_like(hs) if grads is not None else None
        for k in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi, some = self.first[k], self.first[k + 1], slice(edges[k], edges[k + 1])
            hk, t = hs[some], ts[some] - lo
            logits, e = _exponentials(hk, self.w["o"][lo:hi].T, self.w["ob"][lo:hi])
            total = e @ np.ones(hi - lo, e.dtype)
            i = at[: len(t)]
            inside[some] = logits[i, t] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[i, t] -= 1
                grads["o"][lo:hi] += e.T @ hk
                grads["ob"][lo:hi] += e.sum(axis=0)
                below[some] = e @ self.w["o"][lo:hi]
        out[order] += inside
        if grads is None:
            return out
        dh[order] += below
        return out, dh

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum of natural logs over each text (arrays of symbols, END last), the state carried from beginning to end."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        h = np.zeros((len(texts), HIDDEN), dtype=np.float32)
        sums = np.zeros(len(texts))
        last = np.full(len(texts), END)
        for t0 in range(0, int(size[0]), WINDOW):
            hs, ts, who = [], [], []
            for t in range(t0, min(t0 + WINDOW, int(size[0]))):
                live = int(np.searchsorted(-size, -t, side="left"))
                h = self.step(last[:live], h[:live])[0]
                target = flat[begin[:live] + t]
                hs.append(h)
                ts.append(target)
                who.append(live)
                last = target
            got = self.log_probability(np.concatenate(hs), np.concatenate(ts))
            at = 0
            for live in who:
                sums[:live] += got[at : at + live]
                at += live
        total[order] = sums
        return total

    def train(self, texts: list[np.ndarray], epochs: int = 1, lanes: int | None = None, rate: float = RATE) -> None:
        """Truncated backpropagation over all windows of the texts (symbols, END last); Adam steps.

        Texts are laid one after the other into lanes of about equal length, which run side by side; the state is carried through a text and is zero at its beginning.
        """
        texts = sorted((p for p in texts if len(p)), key=len, reverse=True)
        lanes = lanes or min(MOST, max(FEWEST, sum(map(len, texts)) // LANE_TOKENS))
        free, of_lane = [(0, i) for i in range(min(lanes, len(texts)))], [[] for _ in range(min(lanes, len(texts)))]
        for text in texts:  # the longest first, each into the shortest lane
            size, i = heapq.heappop(free)
            of_lane[i].append(text)
            heapq.heappush(free, (size + len(text), i))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        n = 0
        for epoch in range(epochs):
            rng = np.random.default_rng(epoch)
            streams = sorted(([lane[i] for i in rng.permutation(len(lane))] for lane in of_lane), key=lambda lane: -sum(map(len, lane)))
            size = np.array([sum(map(len, lane)) for lane in streams])
            flat, begin = np.concatenate([t for lane in streams for t in lane]).astype(np.int64) if texts else np.zeros(0, np.int64), np.cumsum(size) - size
            fresh = np.append(True, flat[:-1] == END)
            h, last = np.zeros((len(size), HIDDEN), dtype=np.float32), np.full(len(size), END)
            for t0 in range(0, int(size[0]) if texts else 0, WINDOW):
                n += 1
                live = np.searchsorted(-size, -np.arange(t0, min(t0 + WINDOW, int(size[0]))), side="left")  # the longest lanes come first
                at = np.minimum(begin[: live[0]] + t0 + np.arange(len(live))[:, None], len(flat) - 1)
                grads, h = self._window(flat[at], fresh[at], live, h[: live[0]], last[: live[0]])
                last = flat[at[-1]]
                for k, g in grads.items():
                    m[k] += np.float32(0.1) * (g - m[k])
                    s[k] += np.float32(0.01) * (g * g - s[k])
                    self.w[k] -= np.float32(rate / (1 - 0.9**n)) * m[k] / (np.sqrt(s[k] / np.float32(1 - 0.99**n)) + np.float32(1e-4))

    def _window(self, grid: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray, last: np.ndarray):
        """Gradients of the mean loss in one window, and the state at its end.

        grid[t]: symbols of the lanes, of which the first live[t] have not ended before t; fresh: where a text begins.
        """
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        steps, lanes = grid.shape
        there = np.arange(lanes) < live[:, None]
        some = (lambda a: a.reshape(steps * lanes, *a.shape[2:])) if there.all() else (lambda a: a[there])
        fed = np.vstack([last, grid[:-1]])
        x = self.w["x"][fed]
        kind = x.dtype
        keep = (~fresh).astype(kind)[:, :, None]
        before, after = np.zeros((steps, lanes, HIDDEN), kind), np.zeros((steps, lanes, HIDDEN), kind)
        zg, n, rn = np.zeros((steps, lanes, 2 * HIDDEN), kind), np.zeros((steps, lanes, HIDDEN), kind), np.zeros((steps, lanes, HIDDEN), kind)
        for t, k in enumerate(live.tolist()):
            h = np.multiply(h[:k], keep[t, :k], out=before[t, :k])
            r = h @ self.w["h"]
            gates = _sigmoid(x[t, :k, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            zg[t, :k], rn[t, :k] = gates, r[:, 2 * HIDDEN :]
            new = np.tanh(x[t, :k, 2 * HIDDEN :] + gates[:, HIDDEN:] * rn[t, :k])
            n[t, :k] = new
            h = np.add(gates[:, :HIDDEN] * (h - new), new, out=after[t, :k])
        target = some(grid)
        dout = np.zeros_like(n)
        dout[there] = self.log_probability(some(after), target, grads)[1]

        z, g = zg[:, :, :HIDDEN], zg[:, :, HIDDEN:]
        by = np.concatenate([(before - n) * z * (1 - z), rn * g * (1 - g), (1 - z) * (1 - n * n)], axis=2)  # of z; of g and n, both through n
        by[:, :, HIDDEN : 2 * HIDDEN] *= by[:, :, 2 * HIDDEN :]
        dx, back = np.zeros_like(by), np.ascontiguousarray(self.w["h"].T)
        dr = np.zeros_like(by)
        dh = np.zeros((lanes, HIDDEN), kind)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            d = dh[:k] + dout[t, :k]
            np.multiply(by[t, :k].reshape(k, 3, HIDDEN), d[:, None], out=dx[t, :k].reshape(k, 3, HIDDEN))
            dr[t, :k] = dx[t, :k]
            dr[t, :k, 2 * HIDDEN :] *= g[t, :k]
            np.multiply(d * z[t, :k] + dr[t, :k] @ back, keep[t, :k], out=dh[:k])
        grads["h"] += some(before).T @ some(dr)
        dx, fed = some(dx), some(fed)
        order = np.argsort(fed, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(fed[order]) != 0))
        grads["x"][fed[order][starts]] = np.add.reduceat(dx[order], starts, axis=0)
        for k in grads:
            grads[k] /= len(target)
        return grads, after[-1]


class Head:
    """Counts of the commonest words; the first SYMBOLS are symbols 2, 3, ..."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int):
        self.place = {w: i for i, w in enumerate(words)}
        self.log = np.log10(np.array(counts, dtype=np.float64) + 1)
        self.counts = np.array(counts, dtype=np.int64)
        self.ends = ends
        self.symbols = 2 + min(SYMBOLS, len(words))

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def encode(self, place: np.ndarray) -> np.ndarray:
        return np.append(np.where((place >= 0) & (place < self.symbols - 2), place + 2, OTHER), END).astype(np.int16)


def token_counts(docs: DataFrame) -> DataFrame:
    """word (binary; the end is empty), c: how often it stands in the texts of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(words_of(text))
                seen[b""] += 1
            if len(seen) > 300_000:
                yield told()
                seen.clear()
        yield told()

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _commonest(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The commonest words (word, c), `most` at most: all above the least count at which so many are not exceeded. Counts are told apart to 1/64 of a power of two."""
    step = F.floor(F.log2("c") * 64)
    shares = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"])  # 64 rows for each power of two at most
    held, least = 0, None
    for r in shares:
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return [], []
    top = counts.filter(step >= least).orderBy(F.desc("c"), "word").toArrow()
    return top.column("word").to_pylist(), top.column("c").to_pylist()


def _averaged(docs: DataFrame, head: Head, model: Gru, groups: int = 16) -> Gru:
    """The mean, weighted by tokens, of what each partition makes of model on all tokens of all its texts (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, held, waiting = pickle.loads(pickle.dumps(model)), 0, [], 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                held.append(head.encode(head.places(words_of(text))))
                tokens += len(held[-1])
                waiting += len(held[-1])
                if len(held) >= HELD_TEXTS or waiting >= HELD_TOKENS:
                    own.train(held)
                    held, waiting = [], 0
        own.train(held)
        if tokens:
            part = int(np.uint32(tokens * 2654435761 & 0xFFFFFFFF)) % groups
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([pickle.dumps(own.w)], pa.binary()), pa.array([part], pa.int32())], names=["tokens", "w", "part"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total, share = None, pdf["tokens"].to_numpy() / pdf["tokens"].sum()
        for blob, f in zip(pdf["w"], share):
            w = pickle.loads(blob)
            total = {k: v * np.float32(f) + (total[k] if total else 0) for k, v in w.items()}
        return pd.DataFrame({"tokens": [pdf["tokens"].sum()], "w": [pickle.dumps(total)], "part": [0]})

    schema = "tokens long, w binary, part int"
    parts = docs.select("doc_id", "text").mapInArrow(run, schema).groupBy("part").applyInPandas(mean, schema).toPandas()
    if len(parts):
        model.w = pickle.loads(mean(parts)["w"].iloc[0])
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the model's log10 probability of the whole text and its end; base_score that of add-one smoothed
    counts. A null text counts as empty: its one token is the end. A null id is not held out. Without training
    texts every token is unknown and the model is an untrained one. Repeated rows are each scored (and learned
    from). An empty table gives no rows. Other columns are not looked at. Every partition trains on all of its training
    texts and weights are averaged, so score (not the other columns) depends on how the table is split. The result is a
    table in `into`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    into = into or Scratch(spark)
    with scratch(spark) as own:
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        return into.stored(_scores(rows, own))


def _scores(rows: DataFrame, own: Scratch) -> DataFrame:
    spark = rows.sparkSession
    training = rows.filter(~held_out(F.col("doc_id")))
    counts = own.stored(token_counts(training))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    head = Head(*_commonest(counts.filter(F.length("word") > 0), HEAD), ends)
    symbol_counts = head.counts[: head.symbols - 2]
    other = n - ends - int(symbol_counts.sum())  # tokens and types beyond the symbols
    other_types = v - (ends > 0) - len(symbol_counts)
    base_log, other_log = np.log10(n + v + 1), np.log10(other + other_types + 1)

    model = Gru(head.symbols)
    model.start_from(np.concatenate([[other, ends], symbol_counts]).astype(np.float64))
    # there is an end for each training text; a few times FIRST_TEXTS are looked at for those with the least hashes
    place, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), min(1.0, 3 * FIRST_TEXTS / max(ends, 1))
    first = training.filter(place < int(share * (1 << 30))).orderBy(place, "doc_id").limit(FIRST_TEXTS).select("text").toArrow().column(0).to_pylist()
    model.train([head.encode(head.places(words_of(t))) for t in first], epochs=3, lanes=16, rate=0.01)
    model = _averaged(training, head, model)
    shared = spark.sparkContext.broadcast((head, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model = shared.value
        rare = head.symbols - 2
        held: list[tuple] = []
        tokens = 0

        def told() -> pa.RecordBatch:
            natural = model.score([h[-1] for h in held])
            columns = list(zip(*held))
            score = natural / np.log(10) + np.array(columns[4]) - other_log * np.array(columns[5])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(score),
                    pa.array(columns[6], pa.list_(pa.binary())), pa.array(columns[7], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_tokens", "n_known", "logs", "score", "words", "times"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                place = head.places(words)
                known = place >= 0
                logs = head.log[place[known]]
                beyond = Counter([words[i] for i in np.flatnonzero(~known).tolist()])
                symbols = head.encode(place)
                held.append((
                    doc_id, len(words) + 1, int(known.sum()) + (head.ends > 0), float(logs.sum()) + float(np.log10(head.ends + 1)),
                    float(head.log[place[place >= rare]].sum()), int((symbols == OTHER).sum()), list(beyond.keys()), list(beyond.values()), symbols,
                ))
                tokens += len(symbols)
            if len(held) >= 8192 or tokens > 4_000_000:
                yield told()
                held, tokens = [], 0
        if held:
            yield told()

    passed = own.stored(
        rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, logs double, score double, words array<binary>, times array<long>").withColumn("row", F.monotonically_increasing_id())
    )
    rare = passed.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return passed.select("row", "doc_id", "n_tokens", "n_known", "logs", "score").join(met, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(float(base_log))).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
