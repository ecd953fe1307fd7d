"""Language identification in two levels: family first, then one-versus-one linear SVMs within the family.

Features are hashed counts of letter bigrams, trigrams and word beginnings over the whole text, on a square-root scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import bounded_batches

DIM = 2048
UNDETERMINED = "und"
#: How far below the least known of the labelled texts a text may lie, as a share of that one's distance to the median.
SLACK = 0.25

#: Families of common language codes. A code that is missing here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}


def features(text: str) -> np.ndarray | None:
    """DIM floats of unit length, or None if the text has no letter."""
    if not any(map(str.isalpha, text)):
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    # anything but a letter is a blank; what is no letter among ASCII is known at once, the rest is kept
    code = np.where((code < 128) & ((code < 97) | (code > 122)), np.uint32(32), code)
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) ^ code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    lettered = (code[:-1] != 32) | (code[1:] != 32)
    grams = np.concatenate([two[lettered], (three ^ np.uint32(0x5BD1E995))[lettered[:-1] | lettered[1:]]])
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    counts = np.sqrt(np.bincount(grams >> np.uint32(32 - 11), minlength=DIM))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 300.0, rounds: int = 150) -> tuple[np.ndarray, float, float]:
    """Squared-hinge linear SVM by accelerated gradient steps. y: +-1. Weights, bias, and a slope that turns margins into probabilities."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)  # both classes weigh the same
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, momentum = w.copy(), 1.0
    step = np.float32(1 / (1 + 4 * c))
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead - np.float32(2 * c) * ((weight * y * short) @ x))
        then = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + np.float32((momentum - 1) / then) * (new - w)
        w, momentum = new, then
    margin = y * (x @ w)
    slope = 1.0
    for _ in range(50):  # the slope of the logistic likelihood, kept finite where the classes are apart
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        slope = float(np.clip(slope + 0.5 * (weight * margin * (1 - p)).sum() / max(1e-9, (weight * margin**2 * p * (1 - p)).sum()), 0.5, 8.0))
    return w[:-1].astype(np.float32), float(w[-1]), slope


def profile(x: np.ndarray) -> np.ndarray:
    """Logs of the mean shares of features, lightly smoothed; the squares of a row of x are the shares of its features."""
    share = (x.astype(np.float64) ** 2).sum(axis=0) + 1 / DIM
    return np.log(share / share.sum())


def floor_of(x: np.ndarray) -> float:
    """A mean log share that texts of the language of x stay above: each half of x is read with the profile of the other."""
    if len(x) < 2:
        return -np.inf
    read = np.concatenate([x[i::2].astype(np.float64) ** 2 @ profile(x[1 - i :: 2]) for i in (0, 1)])
    return float(read.min() - SLACK * (np.median(read) - read.min()))


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    family_svm: dict[str, tuple[np.ndarray, float, float]]  # one against the rest
    pair_svm: dict[tuple[str, str], tuple[np.ndarray, float, float]]
    profiles: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)  # of each language, with its floor

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray, family_of: dict[str, str] = FAMILIES) -> LanguageModel:
        families: dict[str, list[str]] = {}
        for code in sorted(set(lang)):
            families.setdefault(family_of.get(code, code), []).append(code)
        family = np.array([family_of.get(c, c) for c in lang])
        of_family = {f: linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
        of_pair = {}
        for codes in families.values():
            for a, b in combinations(codes, 2):
                some = (lang == a) | (lang == b)
                of_pair[a, b] = linear_svm(x[some], np.where(lang[some] == a, 1.0, -1.0))
        return cls(families, of_family, of_pair, {c: (profile(x[lang == c]), floor_of(x[lang == c])) for c in set(lang)})

    def knows(self, x: np.ndarray, lang: list[str]) -> np.ndarray:
        """Whether the rows of x read like the labelled texts of the languages that they were given, and not only more like them than like others."""
        out = np.zeros(len(x), dtype=bool)
        for i, (row, code) in enumerate(zip(x, lang)):
            if code in self.profiles:
                logs, floor = self.profiles[code]
                out[i] = row.astype(np.float64) ** 2 @ logs >= floor
        return out

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of the rows of x: the probability of the family times that of the language in it."""
        names = sorted(self.families)
        if not names:
            return [UNDETERMINED] * len(x), np.zeros(len(x))

        def sure(svm):
            w, b, slope = svm
            return 1 / (1 + np.exp(-np.clip(slope * (x @ w + b), -30, 30)))

        p = np.column_stack([sure(self.family_svm[f]) for f in names]) if self.family_svm else np.ones((len(x), 1))
        p /= p.sum(axis=1, keepdims=True)
        chosen = p.argmax(axis=1)
        lang, score = np.empty(len(x), dtype=object), p[np.arange(len(x)), chosen]
        for f, name in enumerate(names):
            at = np.flatnonzero(chosen == f)
            codes = self.families[name]
            votes, trust = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                w, b, slope = self.pair_svm[codes[i], codes[j]]
                q = 1 / (1 + np.exp(-np.clip(slope * (x[at] @ w + b), -30, 30)))
                votes[:, i] += q >= 0.5
                votes[:, j] += q < 0.5
                trust[:, i] += q
                trust[:, j] += 1 - q
            if len(codes) > 1:
                trust /= len(codes) - 1
                best = (votes + 0.5 * trust).argmax(axis=1)
                score[at] *= trust[np.arange(len(at)), best]
            else:
                best = np.zeros(len(at), dtype=int)
            lang[at] = np.array(codes, dtype=object)[best]
        return lang.tolist(), np.clip(score, 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    """True for documents that no model may learn from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 600, sample: int = 20_000) -> LanguageModel:
    """Fit on a sample chosen by a hash of the id: at most sample_per_language documents of each language, and about `sample` in all, of all languages alike.

    Rows without a language, without letters or held out teach nothing; without any others all predictions are `und`.
    """
    labelled = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return LanguageModel({}, {}, {})
    sample_per_language = max(2, min(sample_per_language, sample // len(counts)))
    wide = sample_per_language + 3 * sample_per_language**0.5 + 10  # expected, so that few draws come out short and none empty
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, wide / r["count"]))])
    drawn = labelled.filter(F.element_at(share, F.col("lang")) > place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else v.tobytes() for v in x], pa.binary()), batch.column(1), batch.column(2)], names=["x", "lang", "place"])

    rows = drawn.select("text", "lang", place.alias("place")).mapInArrow(run, "x binary, lang string, place double").filter("x is not null")
    got = rows.toArrow().to_pandas().sort_values(["lang", "place"]).groupby("lang").head(sample_per_language)
    if not len(got):
        return LanguageModel({}, {}, {})
    return LanguageModel.fit(np.vstack([np.frombuffer(b, dtype=np.float32) for b in got["x"]]), got["lang"].to_numpy())


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score. Null texts and texts without a letter are `und` with score 0.

    Only the text is looked at. A null id stays null; repeated rows are each predicted.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_predictor(model), SCHEMA)


def _predictor(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(1).to_pylist()]
            at = [i for i, v in enumerate(x) if v is not None]
            lang, score = [UNDETERMINED] * len(x), [0.0] * len(x)
            if at:
                said, sure = model.predict(np.vstack([x[i] for i in at]))
                for i, code, s in zip(at, said, sure.tolist()):
                    lang[i], score[i] = code, s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row: learned from the rows that are not held out, applied to all.

    A null text is `und` with score 0; a null id is not held out; repeated rows are each predicted; no rows give none. Other columns are not read.
    """
    found = predict(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_sure(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs (with doc_id, text, lang) in a language that the model knows, with a score of at least `least`; their own columns.

    The score only weighs the learned languages against each other, so the text must also read like the labelled texts of its language.
    Null texts and texts without a letter go; rows without an id, repeated ones and very long texts are judged by their text as any other;
    columns may have any names; no rows give none.
    """
    bounded_batches(docs.sparkSession)
    model = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(text_at).to_pylist()]
            at = [i for i, v in enumerate(x) if v is not None]
            keep = np.zeros(len(x), dtype=bool)
            if at:
                known = np.vstack([x[i] for i in at])
                lang, score = model.predict(known)
                keep[at] = (score >= least) & model.knows(known, lang)
            yield batch.filter(pa.array(keep))

    # columns are passed by position: names may hold dots, or repeat
    text_at, own = docs.columns.index("text"), [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*own)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
