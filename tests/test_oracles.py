"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables where they are present."""

import math
import os

import pytest

from quarryline import catalog

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF_DIR}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_rows_equal(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0
