"""Every query of the library proper against its SQL in DuckDB, at the smallest size."""

import math

import duckdb
import pytest

from lodeweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    cols = list(rel.columns)
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    run = registry.queries()[name]
    first = sorted(map(str, run(spark, SF).collect()))
    assert first and first == sorted(map(str, run(spark, SF).repartition(3).collect()))
