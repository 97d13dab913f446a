"""Each query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from symreach.views.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*' )" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    return names, rel.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def same(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf_dir):
    names, rows = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = same(df.columns, [tuple(r) for r in df.collect()])
    want = same(names, rows)
    assert len(got) == len(want)
    assert got == want
    return len(got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, name):
    compare(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["kind"] for r in rows} >= {"function", "class", "variable", "module"}


def test_each_query_without_sql_runs(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).columns
