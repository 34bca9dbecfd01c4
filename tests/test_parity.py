"""Every named query that has SQL gives the same rows as DuckDB."""

import glob
import math
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")

SF = os.environ.get("QUARRY_SF_DIR", "/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    relation = tables.sql(SQL[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in places) for r in relation.fetchall()]
    assert ordered(got) == ordered(want)
