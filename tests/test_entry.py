"""Every registered query of the engine runs at the smallest scale; those with SQL equal it."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from termweave.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6f}") + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    con = duck.execute(engine.ORACLE[name])
    cols = [c[0] for c in con.description]
    want = sorted(repr(tuple(plain(r[cols.index(c)]) for c in sorted(cols))) for r in con.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
