import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from spotlake.llm import exact_dedup, language_id, minhash, mixing
from spotlake.llm.common import Scratch, connected_components, grown, join_groups
from spotlake.llm.queries import oracle_sql, queries


def test_components(spark):
    into = Scratch(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 103), (103, 202), (None, 3)] + [(500, 501 + i) for i in range(50)] + [(2000 + i, 3000) for i in range(300)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    found = connected_components(frame(edges), into)
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 103, 200: 103, 202: 103} | {500 + i: 500 for i in range(51)} | {2000 + i: 2000 for i in range(300)} | {3000: 2000}
    assert {r.node: r.component for r in found.collect()} == want
    assert connected_components(frame([]), into).count() == 0
    more = [(101, 40), (900, 901), (3, 5), (202, 2299), (901, 50)]
    joined = {r.node: r.component for r in grown(found, frame(more), into).collect()}
    assert joined == {r.node: r.component for r in connected_components(frame(edges + more), into).collect()} and joined[900] == 50
    into.free()


def test_hot_groups_meet_by_broadcast(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 700), (2, 3), (3, 500)) for i in range(n)], "k long, i long")
    groups = spark.createDataFrame([(1, 700, "x"), (2, 3, "y"), (4, 900, "z")], "k long, n long, v string")
    got = join_groups(rows, groups, "k", "n", 1203)
    assert sorted(map(tuple, got.collect())) == sorted([(1, i, "x") for i in range(700)] + [(2, i, "y") for i in range(3)])


def test_pipeline(spark, frame, tmp_path):
    pytest.importorskip("public_tokenizers")
    words = [f"the of and that with word{i}" for i in range(40)]
    texts = [" ".join(words[i % 20 : i % 20 + 15]) + f" unique{i} tail" for i in range(30)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s0", 1), (101, "123 456", "en", "s1", 7), (102, texts[4] + " more", "en", "s1", 7)]
    frame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long").filter("doc_id <> 101")
    want = {r.doc_id: r.text for r in minhash.keep_one(exact_dedup.keep_one(docs)).collect()}
    assert {r.doc_id for r in got} == set(want) and 101 not in want
    assert all(r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash", "mixing", "byte_bpe"]


def test_mixed_order_reaches_the_result(spark, frame, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = [(i, f"the house number{i} and the water{i * 7} of that river{i * 13} with this{i * 29}", "en", f"s{i % 5 % 3}") for i in range(90)]
    frame(rows).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    kept = minhash.keep_one(exact_dedup.keep_one(language_id.keep_sure(frame(rows), corpus_pipeline.LEAST_SCORE)))
    want = [r.doc_id for r in sorted(mixing.mix(kept).collect(), key=lambda r: r.position)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(len(want))) and len(want) > 45


def test_odd_documents(spark, odd, none, tmp_path):
    pytest.importorskip("public_tokenizers")
    for name, docs in (("odd", odd.selectExpr("*", "1 as `a.b`", "2 as at")), ("none", none)):
        (tmp_path / name).mkdir()
        docs.coalesce(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        table = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() <= docs.count()


def test_tables_of_a_stage_go(spark, frame, tmp_path):
    docs = frame([(i, f"one two three four five six {i % 20} {'x' * (i // 20)}", "en", "s") for i in range(60)])
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    folder = corpus_pipeline._held[-1].folder.removeprefix("file://")
    assert near.count() == 20 and len(list(Path(folder).iterdir())) == 1  # of all tables only the one that the result reads
    corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).count()
    assert not Path(folder).exists()


def test_registered():
    assert sorted(k.split("_")[0] for k in queries()) == sorted(f"op{i}" for i in range(1, 11))
    assert set(oracle_sql()) <= set(queries())
