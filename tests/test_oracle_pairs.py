"""Every catalog entry with an oracle text equals DuckDB's result on the smallest scale."""

import duckdb
import pytest

from conftest import SMALL

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    res = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(res.columns, res.fetchall())


def test_every_entry_runs(spark):
    for name in sorted(set(E.queries()) - set(ORACLES)):
        assert E.queries()[name](spark, SMALL).count() >= 0, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["qid", "rank", "memory_id", "type", "content", "tags", "created_at", "score"]
