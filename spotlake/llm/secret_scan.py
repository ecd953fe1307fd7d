"""Secrets in texts, found by one combined deterministic automaton in one pass over the bytes.

All rules are compiled into one minimal automaton. Texts are laid end to end and cut into lanes of one length, which step
through the transition array together; where a lane did not begin in the state in which the one before it ended, it is
stepped through again from that state, until both ways meet. The few lanes that reach an accepting state are read
again by the automata of single rules, which give the exact spans: leftmost, longest, not overlapping within a kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.automaton import compile_rules
from spotlake.llm.common import bounded_batches

LANE = 1024


@dataclass(frozen=True)
class Rule:
    """kind; pattern; letters in either case; base; test of a matched string; what the combined automaton looks for.

    Every match that passes the test must hold a match of `sought`; by default that is the pattern itself.
    """

    kind: str
    pattern: str
    fold: bool = False
    base: bool = False
    holds: Callable[[bytes], bool] | None = None
    sought: str = ""


def assigned_value(match: bytes) -> bytes:
    """What follows the first : or = of an assignment, without blanks and one quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return value[1:] if value[:1] in (b'"', b"'") else value


#: The three base kinds, then well-known public token formats. The base kinds are sought in full, with their least lengths; of the
#: others what they begin with, as their full patterns, counted side by side with the base kinds, make over 40,000 states in place of about 1,000.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, True, lambda m: len(assigned_value(m)) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, True, lambda m: len(m) >= 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", False, True, lambda m: len(m) >= 32, r"[0-9a-f]{32}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", sought="gh[oprsu]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", sought="xox[abprs]-"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", sought="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", sought=r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", sought="-----BEGIN "),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([(r.sought or r.pattern, r.fold) for r in rules], True)
        self.flat = (self.all.next * 256).reshape(-1).astype(np.int32)
        self.accepting = int(np.argmax(self.all.labels > 0)) * 256 if (self.all.labels > 0).any() else 1 << 30
        self.steps = [row.tolist() for row in self.all.next]
        self.labels = self.all.labels.tolist()
        self.single, self.used = [], self.all.used.copy()
        for r in rules:
            d = compile_rules([(r.pattern, r.fold)], False)
            self.single.append(([row.tolist() for row in d.next], d.labels.tolist(), d.start, d.dead))
            self.used |= d.used

    def lanes(self, data: np.ndarray) -> np.ndarray:
        """Numbers of the lanes of data in which the combined automaton accepts."""
        n = -(-len(data) // LANE)
        columns = np.full(n * LANE, 10, dtype=np.uint8)
        columns[: len(data)] = data
        columns = np.ascontiguousarray(columns.reshape(n, LANE).T)
        begin = np.full(n, self.all.start * 256, dtype=np.int32)
        end, most = begin.copy(), np.zeros(n, dtype=np.int32)
        for t in range(LANE):
            np.take(self.flat, end + columns[t], out=end)
            np.maximum(most, end, out=most)
        again = np.flatnonzero(end[:-1] != begin[1:]) + 1
        while len(again):
            before, begin[again] = begin[again], end[again - 1]
            now, at = begin[again], again
            for t in range(LANE):
                before, now = self.flat[before + columns[t, at]], self.flat[now + columns[t, at]]
                most[at] = np.maximum(most[at], now)
                apart = before != now
                if not apart.all():
                    before, now, at = before[apart], now[apart], at[apart]
                    if not len(at):
                        break
            end[at] = now
            again = at[at + 1 < n] + 1
            again = again[end[again - 1] != begin[again]]
        return np.flatnonzero(most >= self.accepting)

    def hit(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rules): stretches of data between bytes that no rule reads, with all matches, and the rules that may match there."""
        breaks = np.flatnonzero(~self.used[data])
        stretches: list[list[int]] = []
        for i in self.lanes(data).tolist():
            low, high = np.searchsorted(breaks, [i * LANE, (i + 1) * LANE])
            start, end = int(breaks[low - 1]) + 1 if low else 0, int(breaks[high]) if high < len(breaks) else len(data)
            if stretches and start <= stretches[-1][1]:
                stretches[-1][1] = max(end, stretches[-1][1])
            else:
                stretches.append([start, end])
        out = []
        for start, end in stretches:
            rules, at = 0, self.all.start
            for b in data[start:end].tobytes():
                at = self.steps[at][b]
                rules |= self.labels[at]
            if rules:
                out.append((start, end, rules))
        return out

    def spans(self, r: int, piece: bytes) -> Iterator[tuple[int, int]]:
        table, labels, start, dead = self.single[r]
        first, at, n = table[start], 0, len(piece)
        holds = self.rules[r].holds
        while at < n:
            now = first[piece[at]]
            if now == dead:
                at += 1
                continue
            end, to = 0, at + 1
            while True:
                if labels[now]:
                    end = to
                if to == n or (now := table[now][piece[to]]) == dead:
                    break
                to += 1
            if not end:
                at += 1
                continue
            if holds is None or holds(piece[at:end]):
                yield at, end
            at = end

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """Index of text -> (start, end in bytes, rule), sorted by start, then rule."""
        if not texts:
            return {}
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if self.used[10]:
            raise ValueError("a rule reads line ends, which must separate texts")
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi, rules in self.hit(data):
            piece = data[lo:hi].tobytes()
            for r in range(len(self.rules)):
                if rules >> r & 1:
                    for a, b in self.spans(r, piece):
                        doc = int(np.searchsorted(offsets, lo + a, side="right")) - 1
                        found.setdefault(doc, []).append((lo + a - int(offsets[doc]), lo + b - int(offsets[doc]), r))
        for spans in found.values():
            spans.sort(key=lambda x: (x[0], x[2]))
        return found


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(at[a]), int(at[b]), r) for a, b, r in spans]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, the digest of the base spans, and all spans.

    Spans are kind:start:end in code points, by start, then kind as listed. A null text counts as empty and
    has no spans; a null id stays null; repeated rows are each reported; a very long text is read whole; other columns are
    not read, whatever their names; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        kinds = [r.kind for r in RULES]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            n = len(texts)
            counts, digests, said = [[0] * n for _ in range(3)], [nothing] * n, [""] * n
            for i, spans in scanner.scan(texts).items():
                shown = [(f"{kinds[r]}:{a}:{b}", r) for a, b, r in in_code_points(texts[i], spans)]
                base = [x for x, r in shown if RULES[r].base]
                for _, r in shown:
                    if RULES[r].base:
                        counts[r][i] += 1
                digests[i] = hashlib.sha256(",".join(base).encode()).hexdigest()
                said[i] = ",".join(x for x, _ in shown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(said, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCHEMA)
