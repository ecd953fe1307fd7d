"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

The words of many texts are found at once from the character classes of a flat array. Words not met
before are encoded together: their symbols lie in one flat array, the ranks of all neighbouring pairs
come from a binary search in the sorted pair keys, and each round merges in every word its pair of the
lowest rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import bounded_batches

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Words that a worker remembers; beyond it starts afresh.
REMEMBERED = 400_000
NO_RANK = np.int32(1 << 30)


@lru_cache(1)
def char_classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    spaces = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    return table


def word_bounds(text: str) -> np.ndarray:
    """Starts of the pre-tokens of a text, with its length at the end.

    The pre-tokens are those of 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks not before a non-blank|blanks.
    """
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    if not n:
        return np.zeros(1, dtype=np.int64)
    kind = char_classes()[code]
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    run = np.flatnonzero(change)  # starts of runs of one class
    end = np.append(run[1:], n)
    k = kind[run]
    begin = np.zeros(n + 1, dtype=bool)
    begin[run] = True
    begin[n] = True
    # the last blank of a run before a non-blank stands alone, or with what follows if it is a plain space
    inner = np.flatnonzero((k == SPACE) & (end < n))
    last = end[inner] - 1
    begin[last] = True
    joined = inner[code[last] == 32]
    begin[end[joined]] = False
    # contractions: a lone apostrophe that no space precedes, then letters
    quote = np.flatnonzero((k == OTHER) & (end - run == 1) & (code[run] == 39))
    quote = quote[(quote + 1 < len(run))]
    quote = quote[(k[quote + 1] == LETTER) & begin[run[quote]]]
    for q in quote.tolist():
        at = int(run[q]) + 1
        size = 1 if chr(code[at]) in "stmd" else 2 if text[at : at + 2] in ("re", "ve", "ll") else 0
        if size:
            begin[at] = False
            begin[at + size] = True
    return np.flatnonzero(begin)


class ByteBpe:
    """A tokenizer file of kind byte-level BPE, read from `path`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        byte_of = {c: b for b, c in shown.items()}
        self.base = np.uint32(max(vocab.values()) + 1)
        if int(self.base) ** 2 > 1 << 32:
            raise ValueError("keys of pairs need 32 bits at most")
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], dtype=np.uint32)
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.uint32)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)[order]
        self.ids: dict[str, bytes] = {}  # word -> its ids as int32 bytes
        self.said: dict[str, str] = {}  # word -> its ids in decimals, joined by commas
        self.back: dict[str, bytes] = {}  # word -> bytes that its ids decode to

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols, NO_RANK where they don't merge, and what they merge to."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.rank[at], NO_RANK), self.merged[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words laid end to end, number of ids of each word). No word is empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank, to = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=self.byte_id.dtype)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._ranks(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NO_RANK
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            best_of = np.repeat(best, np.diff(np.append(starts, len(sym))))
            over = best_of == NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            pick = np.flatnonzero((rank == best_of) & ~over)
            if len(pick):  # of overlapping occurrences every second one, from the left
                fresh = np.append(True, np.diff(pick) != 1)
                head = np.maximum.accumulate(np.where(fresh, pick, 0))
                pick = pick[(pick - head) % 2 == 0]
                sym[pick] = to[pick]
            keep = ~over
            keep[pick + 1] = False
            changed = (np.cumsum(keep) - 1)[pick]
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            if len(changed):  # only pairs with a new symbol get new ranks
                flag = np.zeros(len(sym) + 1, dtype=bool)
                flag[changed] = flag[changed - 1] = True  # -1 falls on the spare last place
                at = np.flatnonzero(flag[:-1])
                last = at == len(sym) - 1
                inner = at[~last]
                fresh_rank, to[inner] = self._ranks(sym[inner], sym[inner + 1])
                rank[inner] = np.where(word[inner] == word[inner + 1], fresh_rank, NO_RANK)
                rank[at[last]] = NO_RANK
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def words(self, text: str) -> list[str]:
        parts = [text]
        for token in self.special:
            if token in text:
                parts = [y for x in parts for y in ([x] if x in self.special else _around(x, token))]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                at = word_bounds(part).tolist()
                out += [part[a:b] for a, b in zip(at, at[1:])]
        return out

    def learn(self, words: set[str], decoding: bool) -> None:
        """Make the entries of words that are not known yet."""
        if len(self.ids) + len(self.said) > REMEMBERED:
            self.ids, self.said, self.back = {}, {}, {}
        new = list(words.difference(self.said if decoding else self.ids))
        for token in [w for w in new if w in self.special]:
            self._note(token, np.array([self.special[token]], dtype=np.int64), decoding)
        new = [w for w in new if w not in self.special]
        for lo in range(0, len(new), 50_000):
            some = new[lo : lo + 50_000]
            flat, sizes = self.merge([w.encode() for w in some])
            ends = np.cumsum(sizes).tolist()
            at = 0
            for w, end in zip(some, ends):
                self._note(w, flat[at:end], decoding)
                at = end

    def _note(self, word: str, ids: np.ndarray, decoding: bool) -> None:
        if decoding:  # either kind of entry is complete in itself; a worker may be asked for both
            each = ids.tolist()
            self.said[word] = ",".join([self.decimal[i] for i in each])
            self.back[word] = b"".join([self.bytes_of[i] for i in each])
        else:
            self.ids[word] = ids.astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        words = [self.words(t) for t in texts]
        self.learn(set().union(*words) if words else set(), False)
        get = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), dtype="<i4") for w in words]

    def round_trip(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimals and the bytes that they decode to."""
        words = [self.words(t) for t in texts]
        self.learn(set().union(*words) if words else set(), True)
        for w in words:
            yield ",".join(map(self.said.__getitem__, w)), b"".join(map(self.back.__getitem__, w))

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[int(i)] for i in ids]).decode("utf-8", "replace")


def _around(text: str, token: str) -> list[str]:
    out: list[str] = []
    pieces = text.split(token)
    for i, piece in enumerate(pieces):
        out += [token, piece] if i else [piece]
    return out


@lru_cache(2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, number of ids, digests of the ids and of the text decoded from them.

    path: the tokenizer file, at the same place on every executor. A null text counts as empty and has no
    ids; a null id stays null; repeated rows are each encoded; other columns are not read, except that the long
    position_col, if given, is passed on as the last column `position`.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            counts, ids, back = [], [], []
            for said, decoded in bpe.round_trip([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(said.count(",") + 1 if said else 0)
                ids.append(hashlib.sha256(said.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), *batch.columns[2:]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *position],
            )

    position = ["position"] if position_col else []
    passed = [F.col(f"`{position_col}`").cast("long").alias("position")] if position_col else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *passed)
    return rows.mapInArrow(run, SCHEMA + ", position long" if position_col else SCHEMA)
