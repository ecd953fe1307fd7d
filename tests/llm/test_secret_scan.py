import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotlake.llm.automaton import compile_rules
from spotlake.llm.secret_scan import RULES, Scanner, in_code_points, secrets

SCANNER = Scanner()
PATTERNS = [re.compile(r.pattern.encode(), re.I if r.fold else 0) for r in RULES]
PIECES = ["password", "token", "secret", "api_key", "apikey", "PassWd", "AKIA", "A1B2C3D4E5", "0123456789abcdef", "deadbeef", ":", "=", " ", '"', "'", "x", "\n", "é", "ghp_", "abcdefghijkl", "-", "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----"]


def brute(text: bytes):
    out = []
    for k, (p, r) in enumerate(zip(PATTERNS, RULES)):
        for m in p.finditer(text):
            if r.holds is None or (len(m.group(2)) >= 8 if r.kind == "assign" else r.holds(m.group())):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_against_backtracking():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))).encode() for _ in range(1500)]
    texts += [b"0123456789abcdef" * 5000 + b" token: abcdefgh1", b""]
    found = SCANNER.scan(texts)
    assert all(found.get(i, []) == brute(t) for i, t in enumerate(texts))
    assert len(found) > 100


def test_matches_over_the_borders_of_lanes():
    secrets_ = [b"password = hunter2hunter2", b"AKIA" + b"Q" * 30, b"0123456789abcdef" * 400, b"ghp_" + b"k" * 40, b"token:" + b"v" * 5000, b"-----BEGIN RSA PRIVATE KEY-----"]
    rng = random.Random(7)
    for base in (b"plain words without any", b"abcdef0123 token AK ghp eyJ password "):
        texts = []
        for _ in range(30):
            text = b""
            while len(text) < 9000:
                text += base * rng.randint(0, 40) + b" " + rng.choice(secrets_) + b" "
            texts.append(text)
        found = SCANNER.scan(texts)
        assert all(found.get(i, []) == brute(t) for i, t in enumerate(texts))


def test_rules_of_the_caller_are_sought_as_they_are():
    own = Scanner((RULES[0].__class__("hex", "z+q"), RULES[0].__class__("pem", "<[a-z]+>")))
    assert own.scan([b"zzq <ab> zz", b"\xc3\xa9zq<b>"]) == {0: [(0, 3, 0), (4, 8, 1)], 1: [(2, 4, 0), (4, 7, 1)]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=5))
def test_automata_are_minimal_and_right(texts):
    d = compile_rules([("a(b|c)*a", False), ("b{2,3}c?", False)], True)
    for t in texts:
        at, hit = d.start, 0
        for b in t.encode():
            at = d.next[at, b]
            hit |= int(d.labels[at])
        assert (hit & 1 > 0) == bool(re.search("a[bc]*a", t)) and (hit & 2 > 0) == bool(re.search("bb", t))


def test_minimal_size():
    assert compile_rules([("(a|b)*abb", False)], False).size == 5  # with the dead state
    assert compile_rules([("ab|AB", True)], False).size == compile_rules([("ab", True)], False).size


def test_code_points():
    text = "é漢 token=abcdefgh12".encode()
    assert in_code_points(text, brute(text)) == [(3, 19, 0)]
    with pytest.raises(ValueError):
        Scanner((RULES[0].__class__("nl", "a\nb"),)).scan([b"x"])


def test_query_rows(odd, none):
    got = {r.doc_id: r for r in secrets(odd).collect() if r.doc_id is not None}
    assert secrets(odd).count() == odd.count() and secrets(none).count() == 0
    assert got[8].spans == "assign:8:24" and got[8].n_assign == 1
    assert got[9].spans == "hex:0:64" and (got[1].spans, got[5].spans) == ("", "")
    assert np.isclose(got[9].n_hex, 1)
