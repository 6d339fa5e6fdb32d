"""Every query with SQL gives DuckDB's rows."""

import decimal
from collections import Counter

import duckdb
import pytest

from marginalia.plans import audits, claims, dialogue, documents, events, finite, fixtures, graphs, more, records, routes, steps  # noqa: F401
from marginalia.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(v) if v != int(v) else str(int(v))
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, sf_dir).count() > 0, name
