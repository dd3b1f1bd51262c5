"""Every registered query against its SQL on the smallest test data."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
NAMES = sorted(n for n in entry.queries() if "llm" not in entry.queries()[n].__module__)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    if name not in entry.oracle_sql():
        assert df.columns
        return
    want = db.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
