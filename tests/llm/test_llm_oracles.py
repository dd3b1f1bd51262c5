"""The registered queries of this subpackage against their SQL on the smallest test data."""

from __future__ import annotations

import glob
import math
import os

import pytest

from quadloom.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in Q.ORACLES:
        assert df.columns
        return
    db = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.sql(Q.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())
