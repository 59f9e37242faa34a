"""Every query with SQL gives the same rows as DuckDB does on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


NAMES = sorted(set(entry.oracle_sql()))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
    assert len(ours) > 0


def test_all_queries_have_a_schema(spark):
    assert set(NAMES) <= set(entry.queries())
    assert entry.entry(spark).count() == 13
