"""Every query with SQL gives what DuckDB gives, over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entries
from spotlake.operators import identify
from spotlake.plans import lenses
from spotlake.plans.queries import QUERIES, SQL

FOLDER = os.environ.get("SPOTLAKE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in got.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entries.entry(spark).count() > 0
    assert set(entries.oracle_sql()) <= set(entries.queries())


@pytest.mark.parametrize("name", ["q_find_circles", "q_find_beads", "q_find_buttons"])
def test_finders_find_all_of_many_disks(spark, monkeypatch, name):
    rows = [("a", 10 * i + j, i, j, 100.0 * (i + 1), 100.0 * (j + 1), "t") for i in range(100) for j in range(10)]
    chip = spark.createDataFrame(rows, "assay string, mark int, mark_row int, mark_col int, y double, x double, tag string")
    monkeypatch.setattr(lenses, "chip", lambda spark, d: chip)
    found = [(r.y, r.x, r.sized) for r in QUERIES[name](spark, "").collect()]
    assert sorted(found) == sorted((int(r[4]), int(r[5]), True) for r in rows)


def test_regions_and_masks_agree_however_rows_arrive(spark, monkeypatch):
    (rois, masks), of = lenses.regions(spark, FOLDER), lenses.of
    monkeypatch.setattr(lenses, "of", lambda *a: of(*a).repartition(3, "l_extendedprice").sortWithinPartitions("l_tax"))
    found = [{(r.mark, r.channel): r.i for r in identify.intensities(rois, m).collect()} for m in (masks, lenses.regions(spark, FOLDER)[1])]
    assert found[0] == found[1]
