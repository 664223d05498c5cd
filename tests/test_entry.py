import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from folioframe.plans import queries as core

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "q_category_tiles" in q and "p3_found" in q


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data isn't here")
def test_flagship(spark):
    r = entry.entry(spark).collect()
    assert len(r) > 0 and [x.ord for x in r] == sorted(x.ord for x in r)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data isn't here")
@pytest.mark.parametrize("name", ["q_totals", "q_merge", "q_slugs", "q_to_html", "q_pages", "q_continue_reading", "p3_found"])
def test_core_queries_run(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data isn't here")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_rows_equal_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(core.SQL[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in row) for row in result.fetchall())
    got = Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
