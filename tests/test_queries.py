"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillbank.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(records, columns):
    fixed = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else int(v) if isinstance(v, bool) is False and hasattr(v, "__index__") else v
    return sorted((tuple(fixed(r[c]) for c in columns) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine, theirs = rows([r.asDict() for r in got.collect()], columns), rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a + b) else [x if not isinstance(x, float) else pytest.approx(x, abs=2e-5) for x in a] == list(b)
