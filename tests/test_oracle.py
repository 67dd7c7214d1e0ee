"""Every entry with a DuckDB twin gives the same rows, types of numbers apart."""

import datetime
import math

import duckdb
import pytest

from lakeweave.operators.relational import REL
from lakeweave.operators.sharding import SHARDS, STREAM
from lakeweave.operators.statements import SQL
from lakeweave.plans.ssb import SSB
from lakeweave.plans.tpch import TPCH
from lakeweave.sources.catalog import Tables

ENTRIES = {**TPCH, **SSB, **REL, **SHARDS, **STREAM, **SQL}
VIEWS = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{float(value):.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", ENTRIES)
def test_same_rows(spark, duck, small, name):
    df = ENTRIES[name].run(Tables(spark, small))
    theirs = duck.execute(ENTRIES[name].sql)
    columns = [c[0] for c in theirs.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert mine == sorted(tuple(plain(v) for v in r) for r in theirs.fetchall())
