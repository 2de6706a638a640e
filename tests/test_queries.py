"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from leafpress import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = in_order([tuple(plain(r[c]) for c in names) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = in_order([tuple(plain(r[i]) for i in at) for r in cur.fetchall()])
    assert got == want
    assert got


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
