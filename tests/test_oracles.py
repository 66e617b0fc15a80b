"""Every query that SQL can express gives the rows of its SQL."""

import math

import duckdb
import pytest

from shinglemill.plans import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(([value(r[i]) for i in order] for r in found), key=str)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sql, small, name):
    df = registry.queries()[name](spark, small)
    cursor = sql.execute(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())
