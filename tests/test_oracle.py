"""Every query with a check statement agrees with DuckDB on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = pathlib.Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"create view {n} as select * from '{FOLDER}/{n}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(float(v), 3) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches(spark, con, name):
    df = entry.queries()[name](spark, str(FOLDER))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want
