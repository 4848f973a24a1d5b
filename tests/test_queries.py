"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from histlake.plans import registry
from histlake.sources import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v if v is None or isinstance(v, (str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=key)
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the generated tables")
def test_collapse_duplicates_reports_every_group(spark):
    """Beyond the 1,000 best ranked, too: the SQL of the search with a limit above the table's rows."""
    from histlake.plans.projection import KNOWLEDGE_SQL, with_
    from histlake.plans.retrieval import search_sql

    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = with_(KNOWLEDGE_SQL, search_sql([["e"]], limit=1_000_000)) + "SELECT record_id, duplicate_count, duplicates FROM found WHERE duplicate_count > 0"
    got = sorted(tuple(r) for r in registry.QUERIES["collapse_duplicates"](spark, sf).collect())
    assert got == sorted(con.execute(sql).fetchall())
