"""Every registered query against its SQL, over the smallest tables."""

from collections import Counter

import duckdb
import pytest

from layerloom.plans.catalogue import ORACLE_SQL, QUERIES
from verify import TABLES, plain


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = Counter(plain(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    cur = db.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == Counter(plain(tuple(r[cols.index(c)] for c in sorted(cols))) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
