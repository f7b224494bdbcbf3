"""Streaming forms run over the events table as a stream, until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookstrata.operators.directory import latest_tickers
from bookstrata.plans.book_queries import _FROM_NOTHING, _fold
from bookstrata.session import scratch_path
from bookstrata.sources import sample
from bookstrata.sources.sample import FEED_SQL, TRADES_SQL
from bookstrata.streaming import jobs
from bookstrata.streaming.state import live_books, track_sequences


def _feed_stream(spark, sf):
    """The sample feed read as a stream."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return sample.feed_of(jobs.stream_table(spark, path, schema))


def stream_sequences(spark, sf):
    e = F.col("event_id")
    rows = _feed_stream(spark, sf).where(e % 97 != 0).select(
        (e % 50).cast("int").alias("conn_id"), F.lit(1).alias("sid"), e.alias("arrival"),
        F.when(e % 107 == 0, None).when(e % 101 == 0, F.expr("event_id div 50 - 1")).otherwise(F.expr("event_id div 50")).alias("seq"),
        (e % 103 == 0).alias("reset"),
    )
    out = jobs.run_available(spark, track_sequences(rows), "sequences")
    return out.select("conn_id", "arrival", "verdict", "expected_seq", "got_seq")


def stream_bus(spark, sf):
    e = F.col("event_id")
    rows = _feed_stream(spark, sf).where(e % 97 != 0).select(
        F.lit("p").alias("publisher"), e.alias("arrival"), F.expr("event_id div 4000").alias("bus_epoch"),
        (e % 4_000 + 1).alias("bus_seq"), F.col("kind").alias("body"),
    )
    out = jobs.follow_long_bus(spark, rows, "bus")
    return out.select("arrival", "reset", "missed", "generation")


def _book_messages(spark, sf):
    """Images and deltas of the feed as bus messages."""
    level = lambda side, first: F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.array(F.lit(side).cast("bigint"), (F.lit(first) + 100 * k).cast("bigint"), F.lit(100_000) + F.col("size_e2")),
    )
    rows = _feed_stream(spark, sf).where(F.col("kind").isin("S", "D"))
    return rows.select(
        "ticker", F.col("event_id").alias("arrival"), F.lit(0).cast("bigint").alias("generation"),
        F.when(F.col("kind") == "S", "snapshot").otherwise("delta").alias("event_type"), F.col("side").cast("int").alias("side"),
        "price_e4", "delta_e2", F.to_json(F.concat(level(0, 4000), level(1, 5100))).alias("levels"), F.lit(False).alias("stale"),
    )


def stream_books(spark, sf):
    """State of every live book after its last message, under the recorder's rules."""
    out = jobs.run_available(spark, live_books(_book_messages(spark, sf), "stale"), "books")
    last = F.max_by(F.struct("after", "best_bid", "best_ask", "levels"), "arrival")
    return out.groupBy("ticker").agg(last.alias("r"), F.count(F.lit(1)).alias("messages")).select("ticker", "messages", "r.*")


def stream_feed_messages(spark, sf):
    """What followers of each market are sent, by kind, when images are the only refreshes."""
    rows = _book_messages(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "snapshot", "refresh").otherwise("delta"))
    out = jobs.run_available(spark, live_books(rows, "drop"), "messages")
    return out.groupBy("outcome", F.coalesce("message", F.lit("-")).alias("message")).agg(F.count(F.lit(1)).alias("messages"))


def stream_latest_tickers(spark, sf):
    """The latest update per market, merged batch by batch into a table."""
    rows = _feed_stream(spark, sf).where(F.col("kind") == "T").select(
        "ticker", "recv_mono_ns", (4000 + 100 * (F.col("event_id") % 21)).cast("int").alias("last_e4")
    )
    path = scratch_path(spark, "latest")
    jobs.keep_latest(spark, rows, "ticker", "recv_mono_ns", path, scratch_path(spark, "latest-state"))
    stored = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
    return latest_tickers(stored).select("ticker", "last_e4")


def stream_routed(spark, sf):
    """Messages of tracked markets only."""
    tracked = sample.feed(spark, sf).where(F.col("user_id") % 3 == 0).select("ticker").distinct()
    rows = jobs.route(_feed_stream(spark, sf).select("ticker", "event_id", "kind"), tracked)
    return jobs.run_available(spark, rows, "routed").groupBy("ticker", "kind").agg(F.count(F.lit(1)).alias("messages"))


QUERIES = {
    f.__name__: f
    for f in (stream_sequences, stream_bus, stream_books, stream_feed_messages, stream_latest_tickers, stream_routed)
}

_SEQ = """ms AS (SELECT CAST(event_id % 50 AS INTEGER) AS conn_id, event_id AS arrival,
  CASE WHEN event_id % 107 = 0 THEN NULL WHEN event_id % 101 = 0 THEN event_id // 50 - 1 ELSE event_id // 50 END AS seq,
  sum(CASE WHEN event_id % 103 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id % 50 ORDER BY event_id) AS era FROM feed WHERE event_id % 97 <> 0),
bs AS (SELECT m.conn_id, m.arrival, m.seq, (SELECT max(o.seq) FROM ms o WHERE o.conn_id = m.conn_id AND o.era = m.era AND o.arrival < m.arrival) AS base FROM ms m)"""
_NO_GAPS = _fold("f", "feed", _FROM_NOTHING.format(cond="")).replace("g.kind = 'G'", "FALSE")

ORACLE = {
    "stream_sequences": f"""WITH {FEED_SQL}, {_SEQ} SELECT conn_id, arrival, CASE WHEN seq IS NULL THEN 'ok' WHEN base IS NULL THEN 'first' WHEN seq = base + 1 THEN 'ok'
      WHEN seq > base + 1 THEN 'gap' ELSE 'duplicate' END AS verdict, CASE WHEN seq <> base + 1 THEN base + 1 END AS expected_seq, CASE WHEN seq <> base + 1 THEN seq END AS got_seq FROM bs""",
    "stream_bus": f"""WITH {FEED_SQL}, b AS (SELECT event_id AS arrival, event_id // 4000 AS e, event_id % 4000 + 1 AS s, lag(event_id // 4000) OVER (ORDER BY event_id) AS pe,
        lag(event_id % 4000 + 1) OVER (ORDER BY event_id) AS ps FROM feed WHERE event_id % 97 <> 0),
      c AS (SELECT arrival, CASE WHEN pe IS NULL THEN 'start' WHEN e <> pe THEN 'epoch' WHEN s <> ps + 1 THEN 'gap' END AS reset,
        CASE WHEN pe IS NULL THEN 0 WHEN e <> pe THEN s - 1 WHEN s <> ps + 1 THEN greatest(0, s - ps - 1) ELSE 0 END AS missed FROM b)
      SELECT arrival, reset, missed, count(reset) OVER (ORDER BY arrival) AS generation FROM c""",
    "stream_books": f"""WITH RECURSIVE {FEED_SQL}, {_NO_GAPS}, z AS (SELECT ticker, max(n) AS messages, arg_max(lv, n) AS lv, arg_max(stale, n) AS stale, arg_max(images, n) AS im FROM f GROUP BY 1)
      SELECT ticker, messages, CASE WHEN im = 0 THEN 'unknown' WHEN stale THEN 'stale' ELSE 'fresh' END AS after,
        list_max(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0 AND x.key > 0), lambda x: x.key)) AS best_bid,
        -list_max(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0 AND x.key < 0), lambda x: x.key)) AS best_ask,
        len(list_filter(map_entries(lv), lambda x: x.value > 0)) AS levels FROM z""",
    "stream_feed_messages": f"""WITH RECURSIVE {FEED_SQL}, {_NO_GAPS}, z AS (SELECT *, lag(stale) OVER (PARTITION BY ticker ORDER BY n) AS was FROM f),
      m AS (SELECT CASE WHEN kind = 'S' THEN 'refreshed' WHEN was THEN 'ignored' WHEN stale THEN 'error' ELSE 'applied' END AS outcome,
        CASE WHEN kind = 'S' THEN CASE WHEN was THEN 'snapshot' ELSE '-' END WHEN was THEN '-' WHEN stale THEN 'resync' ELSE 'delta' END AS message FROM z WHERE n > 0)
      SELECT outcome, message, count(*) AS messages FROM m GROUP BY 1, 2""",
    "stream_latest_tickers": f"WITH {FEED_SQL}, {TRADES_SQL} SELECT ticker, arg_max(price_e4, recv_mono_ns) AS last_e4 FROM trades GROUP BY 1",
    "stream_routed": f"WITH {FEED_SQL} SELECT ticker, kind, count(*) AS messages FROM feed WHERE user_id % 3 = 0 GROUP BY 1, 2",
}
