import numpy as np

from spotlake.llm import pivot_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    n, comp = {}, {}
    ok = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    for i, *_ in rows:
        n[i], comp[i] = 0, i
    links = [(a, b) for a, x, p in ok for b, y, q in ok if a != b and p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98]
    for a, _ in links:
        n[a] += 1
    for _ in range(len(rows)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return n, comp


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 7)):
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((at, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
            at += 1
    return rows


def test_against_brute_force(spark):
    rows = rows_of() + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [], 1), (905, [None] + [1.0] * 15, 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0)]
    n, comp = brute(rows)
    for block in (768, 5):
        got = pivot_index.near_vectors(spark.createDataFrame(rows, SCHEMA), pivots=24, block=block).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (n[i], comp[i]) for i in n}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert max(n.values()) > 1


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 64))
    rows = [(i, (base[i % 150] + rng.normal(size=64) * 0.14).tolist(), 0) for i in range(450)]
    n, _ = brute(rows)
    got = pivot_index.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_links for r in got) >= 0.999 * sum(n.values()) > 0


def test_recall_with_many_pivots(spark, monkeypatch):
    """As many pivots as the largest label asks for, up to the most."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(250, 64))
    rows = [(i, (base[i % 250] + rng.normal(size=64) * 0.13).tolist(), 0) for i in range(750)]
    monkeypatch.setattr(pivot_index, "LIST", 8)
    n, _ = brute(rows)
    got = pivot_index.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_links for r in got) >= 0.995 * sum(n.values()) > 0


def test_labels_in_their_own_type_and_sizes_of_components(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1.2), (2, v, 1.9), (3, v, 1.2), (4, [1e200, 2e200, 3e200], 1.2), (5, [1e-200, 2e-200, 3e-200], 1.2), (6, [1.0, 2.0], 1.2), (7, [2.0, 4.0], 1.2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()}
    assert got == {1: (3, 1), 2: (0, 2), 3: (3, 1), 4: (3, 1), 5: (3, 1), 6: (1, 6), 7: (1, 6)}
    words = [(1, v, "a"), (2, v, "b"), (3, v, "a")]
    got = {r.vec_id: r.component_id for r in pivot_index.near_vectors(spark.createDataFrame(words, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_empty_and_clashing(spark):
    assert pivot_index.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(rows_of()[:9], SCHEMA).selectExpr("*", "1 as v", "2 as w", "3 as near", "4 as component_id")
    assert pivot_index.near_vectors(df).count() == 9
    only = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], SCHEMA)
    assert [(r.n_links, r.kept) for r in pivot_index.near_vectors(only).collect()] == [(0, True)] * 2
