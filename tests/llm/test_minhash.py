import random
import re

import numpy as np

from spotlake.llm import minhash


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return sets, comp


def test_against_brute_force(frame):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice([3, 6, 8, 40, 150]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), "  ".join(copy) if rng.random() < 0.5 else " ".join(copy).upper()))
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(1000 + i, passage + " " + " ".join(rng.choices(vocabulary, k=90))) for i in range(20)]
    sets, comp = brute(rows)
    got = minhash.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert len(set(comp.values())) < len(rows) - 10


def test_links_that_only_the_blocks_find(frame):
    """A chain whose ends are too far apart to link, with the smallest id at one end, and blocks of few rows."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(12):
        rows.append((100 - i if i else 1, " ".join(words)))
        words[5 * i + 3] = f"new{i}"
        words[60 + i * 3] = f"other{i}"
    rng.shuffle(rows)
    old = minhash.BLOCK
    minhash.BLOCK = 2
    try:
        _, comp = brute(rows)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows)).collect()}
    finally:
        minhash.BLOCK = old
    assert got == comp


def test_estimates_are_close():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(600 * share)).astype(np.uint64)
            only = int(600 * (1 - share) / 2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, only).astype(np.uint64)])) for _ in range(2))
            a, b = np.unique(minhash.mix(a)), np.unique(minhash.mix(b))
            errors.append(minhash.estimate(minhash.sketch(a)[None], minhash.sketch(b)[None])[0] - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_small_sets_are_sketched_without_bias():
    """Pairs at a similarity of exactly 0.75: whatever the size, they share a band and their estimate is not far off."""
    rng = np.random.default_rng(1)
    for a, b, both in ((4, 3, 3), (7, 7, 6), (8, 6, 6), (11, 10, 9), (14, 14, 12), (28, 28, 24), (140, 140, 120), (700, 700, 600)):
        estimates = []
        for _ in range(400):
            h = rng.integers(0, 2**64, size=a + b - both, dtype=np.uint64)
            x, y = (minhash.sketch(np.sort(s)) for s in (h[:a], np.concatenate([h[:both], h[a:]])))
            estimates.append(minhash.estimate(x[None], y[None])[0])
            assert (x == y).reshape(-1, minhash.BAND).all(axis=1).any()
        assert abs(np.mean(estimates) - 0.75) < 0.01 and min(estimates) > 0.75 - minhash.SLACK


def test_no_small_link_is_lost(frame):
    rows = []
    for i in range(3000):  # the first seven of eight words: 3 and 4 shingles, similarity exactly 0.75
        words = [f"{i}w{j}" for j in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:7]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows)).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(3000))


def test_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and minhash.near_duplicates(none).count() == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in (1, 2, 7)] == [0, 0, 0] and by_id[4].component_id == 3
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    out = minhash.keep_one(odd)
    assert out.columns == odd.columns and 4 not in [r.doc_id for r in out.collect()]
