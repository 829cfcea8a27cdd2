"""Every registered query with SQL against DuckDB on the smoke tables."""

import duckdb
import pytest

import __spark_entry__
from panelloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x) -> str:
    if x is None or x != x:
        return "null"
    if isinstance(x, float) or hasattr(x, "as_tuple"):
        return f"{float(x):.5g}"
    return str(x)[:10] if hasattr(x, "isoformat") else str(x)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    got = _rows(df.collect(), df.columns)
    cursor = db.execute(registry.oracle_sql()[name])
    assert got == _rows(cursor.fetchall(), [d[0] for d in cursor.description])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2118
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
