"""Every query that has SQL gives its rows; the others run."""

import math

import duckdb
import pytest

from lumenframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([_plain(r[c]) for c in columns] for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted([_plain(r[names.index(c)]) for c in columns] for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 20
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
