import numpy as np
import pytest

from spotlake.llm import token_shards as ts

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 100, 1000, 65_537):
        x = ts.feistel(np.arange(n), n, 5)
        assert sorted(x.tolist()) == list(range(n))
    assert not np.array_equal(ts.feistel(np.arange(100), 100, 5), ts.feistel(np.arange(100), 100, 6))
    far = (1 << 61) - 77
    assert ((x := ts.feistel(np.arange(far - 500, far), far, 3)) < far).all() and len(set(x.tolist())) == 500


def test_shards_are_ranges():
    assert ts.shard_of(np.arange(10), 10, 3).tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def test_every_slot_against_the_permutation(frame, tmp_path):
    """Slots recomputed from texts alone, and reading on from any global slot with the files alone."""
    rng = np.random.default_rng(0)
    rows = [(int(i) * 3 + 50, " ".join(f"word{int(k)}" for k in rng.integers(0, 99, rng.integers(0, 200)))) for i in rng.permutation(150)]
    folder, sequence, key = str(tmp_path / "s"), 64, 99
    got = ts.in_training_order(frame(rows).repartition(5), PATH, folder, sequence=sequence, key=key, shard_bytes=9000).toPandas().sort_values("slot")
    bpe = library()
    parts = max(1, -(-max(len(t.encode()) for _, t in rows) // sequence))
    low, high = min(i for i, _ in rows), max(i for i, _ in rows)
    numbers, want = (high - low + 2) * parts, []
    for i, text in rows:
        ids = bpe.encode(text, add_special_tokens=False).ids
        for part in range(max(1, -(-len(ids) // sequence))):
            place = int(ts.feistel(np.array([(i - low) * parts + part]), numbers, key)[0])
            want.append((place, i, part, ids[part * sequence : (part + 1) * sequence]))
    want.sort()
    assert [(r.slot, r.doc_id, r.part) for r in got.itertuples()] == [(s, w[1], w[2]) for s, w in enumerate(want)]
    shards = -(-sum(len(t.encode()) for _, t in rows) // 9000)
    assert got.shard.tolist() == ts.shard_of(np.array([w[0] for w in want]), numbers, shards).tolist() and shards > 8
    for slot in (0, 1, len(want) // 2, len(want) - 3, len(want)):
        some = ts.read_from(folder, slot, 70, sequence)
        assert [(r["doc_id"], r["part"], r["ids"][: r["n"]].tolist()) for r in some] == [w[1:] for w in want[slot : slot + 70]]
        assert all((r["ids"][r["n"] :] == ts.PAD).all() for r in some)


def test_round_trip_and_repetition(odd, none, tmp_path):
    folder = str(tmp_path / "shards")
    got = ts.in_training_order(odd, PATH, folder, shard_bytes=20_000, sequence=64).toPandas()
    assert sorted(got.slot) == list(range(len(got))) and got.shard.nunique() > 1 and got.doc_id.isna().sum() == 2
    size = ts.record_type(64).itemsize
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 4)}
    for i, text in texts.items():
        ids = []
        for r in got[got.doc_id == i].sort_values("part").itertuples():
            record = ts.read_records(folder, r.shard, r.offset // size, 1, 64)[0]
            assert record["doc_id"] == i and record["part"] == r.part
            ids += record["ids"][: record["n"]].tolist()
        assert ids == library().encode(text or "", add_special_tokens=False).ids
    columns = ["doc_id", "part", "n_tokens", "slot", "checksum"]
    again = ts.in_training_order(odd.repartition(3), PATH, folder, shard_bytes=20_000, sequence=64).toPandas()
    assert again[columns].sort_values("slot").fillna(-1).to_numpy().tolist() == got[columns].sort_values("slot").fillna(-1).to_numpy().tolist()
    assert ts.in_training_order(none, PATH, str(tmp_path / "no")).count() == 0


def test_ids_that_lie_far_apart(frame, tmp_path):
    rows = [(-(1 << 62), "a b c " * 40), ((1 << 62), "d e f " * 40), (-1, "g"), (None, "h"), (0, None), (0, "twice")]
    got = ts.in_training_order(frame(rows), PATH, str(tmp_path / "far"), sequence=16).toPandas()
    assert sorted(got.slot) == list(range(len(got))) and got.doc_id.isna().sum() == 1 and (got.doc_id == -1).sum() == 1 and (got.doc_id == 0).sum() == 2
