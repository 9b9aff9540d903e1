"""Every query of the registry against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from examlark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([tuple(text(r[i]) for i in order) for r in rows])


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(got.columns)
        assert _rows(got.columns, rows) == _rows(columns, cur.fetchall())


def test_every_query_has_sql():
    assert not set(registry.QUERIES) - set(registry.ORACLE_SQL)


def test_entry_survives_without_llm(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
