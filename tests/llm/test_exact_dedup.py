import hashlib
from collections import defaultdict

from spotlake.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


def check(df, got):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    kept = defaultdict(int)
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


def test_odd_rows(odd):
    check(odd, exact_dedup.digest(odd).collect())


def test_hot_texts_are_split(frame):
    df = frame([(i, f"t{i % 3}" if i % 4 else f"own {i}") for i in range(600)])
    for hot_from in (10, 10_000):
        got = exact_dedup.content_sort(df, hot_from=hot_from).collect()
        want = brute([(r.doc_id, r.text) for r in df.collect()])
        assert all((r.keep_id, r.group_size) == want[r.body] for r in got) and len(got) == 600
        assert sum(r.kept for r in got) == len(want)


def test_keep_one_and_empty(odd, none):
    out = exact_dedup.keep_one(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.digest(none).count() == 0
