import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_comparison_has_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"ticker", "stale", "best_bid", "best_ask"} <= set(rows[0].asDict())


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
@pytest.mark.parametrize("name", ["parse_numbers", "uptime", "sequence_verdicts", "trade_candles", "prune_decisions", "topics"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in rel.description], rel.fetchall())
