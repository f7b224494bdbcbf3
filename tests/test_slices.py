from pyspark.sql import functions as F

from bookstrata.operators import replay as R
from tests.test_replay import make_feed, to_tables


def test_only_markets_that_cross_into_a_slice_are_carried(spark, monkeypatch):
    """Of the markets in a slice one at most began in an earlier one; counts of all others need nothing from other slices."""
    written, real = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    changes, _ = R.ordered_changes(*to_tables(spark, make_feed(3, tickers=40, events=2_000, calm=True)))
    log = R.level_log(changes, 128)
    slices = log.select("slice").distinct().count()
    assert slices > 5 and written["shared-slices"].count() <= 2 * slices
    markets = written["carried"].groupBy("slice").agg(F.count_distinct("ticker").alias("n"))
    assert [r.n for r in markets.select("n").distinct().collect()] == [1]
