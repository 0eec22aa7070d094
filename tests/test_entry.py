"""The driver contract, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from barloom import queries as bars


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: tuple(v) if isinstance(v, (list, tuple)) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(bars.queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = bars.queries()[name](spark, sf_dir)
    want = duck.execute(bars.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).first()["sum_volume"] == 3236
    assert set(bars.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
