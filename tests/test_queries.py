"""Every drift query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from plumbline.queries import ORACLES, QUERIES

TABLES = "nation region part lineitem events".split()


def same(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    mine = QUERIES[name](spark, small).toPandas().sort_index(axis=1)
    theirs = con.sql(ORACLES[name]).df().sort_index(axis=1)
    assert list(mine) == list(theirs)
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, name):
    same(spark, small, name)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
