"""Every registered query runs; those with SQL give what DuckDB gives on the same tables."""

import decimal

import duckdb
import pytest

from corpusmill.plans.queries import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def _value(v):
    return round(float(v), 9) if isinstance(v, float | decimal.Decimal) else v


def _sorted(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = _sorted(df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    result = sql.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert rows == _sorted([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])


def test_flagship(spark, sf_dir):
    row = flagship(spark, sf_dir).first()
    assert row["conversations"] == row["unique_conversations"] and row["duplicates"] == 0
