"""Driver tables mapped onto order-book shapes by projection only.

The test tables hold no order book. ``events`` becomes deltas, images, trades and gaps; ``part``
with ``lineitem`` becomes a market listing; the same expressions exist in SQL for comparison.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata import schemas
from bookstrata.session import configure

EPOCH_2024_NS = 1_704_067_200_000_000_000
DAY_2024_S = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one feed row with its kind: S image, G gap, T trade or D delta."""
    return feed_of(table(spark, sf_dir, "events"))


def feed_of(events: DataFrame) -> DataFrame:
    """The feed mapping over an events table or stream."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    eid, uid = F.col("event_id"), F.col("user_id")
    kind = (
        F.when((F.col("event_type") == "signup") & (eid % 4 == 0), "S")
        .when((F.col("event_type") == "error") & (eid % 8 == 0), "G")
        .when(F.col("event_type") == "purchase", "T")
        .otherwise("D")
    )
    ask = F.col("event_type").isin("view", "error")
    price = (
        F.when(eid % 401 == 0, 5500)
        .when(ask, 5100 + 100 * (eid % 10))
        .otherwise(4000 + 100 * (eid % 10))
    )
    size = F.round(F.col("value") * 100).cast("bigint")
    delta = F.when(eid % 503 == 0, F.lit(-10_000_000)).otherwise(
        F.when(eid % 3 == 0, -size).otherwise(size)
    )
    return events.select(
        eid,
        uid,
        "event_type",
        kind.alias("kind"),
        F.concat(
            F.lit("KX"), (uid % 10).cast("string"), F.lit("-E"), (uid % 50).cast("string"),
            F.lit("-T"), uid.cast("string"),
        ).alias("ticker"),
        (uid % 4).cast("short").alias("conn_id"),
        F.lit(1).alias("sid"),
        (us * 1000).alias("recv_wall_ns"),
        (us * 1000 - EPOCH_2024_NS).alias("recv_mono_ns"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"),
        F.when(ask, 1).otherwise(0).cast("tinyint").alias("side"),
        price.cast("int").alias("price_e4"),
        delta.cast("bigint").alias("delta_e2"),
        size.alias("size_e2"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).where(F.col("kind") == "D")
    return rows.select(
        "ticker", "ts_ms", "recv_mono_ns", "recv_wall_ns", "conn_id", "sid",
        F.col("event_id").alias("seq"), "side", "price_e4", "delta_e2",
        F.lit(None).cast("string").alias("own_client_order_id"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bids and ten asks per image."""
    rows = feed(spark, sf_dir).where(F.col("kind") == "S")
    step = F.posexplode(F.sequence(F.lit(0), F.lit(19))).alias("nth", "k")
    wide = rows.select("*", step)
    bid = F.col("k") < 10
    return wide.select(
        "ticker", "recv_wall_ns", "recv_mono_ns", "conn_id", "sid",
        F.col("event_id").alias("seq"),
        F.when(bid, 0).otherwise(1).cast("tinyint").alias("side"),
        F.when(bid, 4000 + 100 * F.col("k")).otherwise(5100 + 100 * (F.col("k") - 10))
        .cast("int").alias("price_e4"),
        (F.lit(100_000) + F.col("size_e2")).cast("bigint").alias("count_e2"),
        F.lit(0).cast("tinyint").alias("reason"),
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).where(F.col("kind") == "G")
    return rows.select(
        "conn_id", "sid", "recv_wall_ns", "recv_mono_ns",
        F.col("event_id").alias("expected_seq"), (F.col("event_id") + 1).alias("got_seq"),
        F.lit(None).cast("bigint").alias("resolved_recv_wall_ns"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as trades; the price walks over the grid with the event number."""
    rows = feed(spark, sf_dir).where(F.col("kind") == "T")
    return rows.select(
        "ticker", F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trade_id"),
        "ts_ms", "recv_wall_ns", "sid", F.col("event_id").alias("seq"),
        (4000 + 100 * (F.col("event_id") % 21)).cast("int").alias("price_e4"),
        F.col("size_e2").alias("count_e2"),
        (F.col("event_id") % 2).cast("tinyint").alias("taker_side"),
        (F.col("event_id") % 50 == 0).alias("is_block"),
        "conn_id", "recv_mono_ns",
    )


# The same mapping as SQL text, for comparison queries.
FEED_SQL = """feed AS (
  SELECT event_id, user_id, event_type,
    CASE WHEN event_type='signup' AND event_id % 4 = 0 THEN 'S'
         WHEN event_type='error' AND event_id % 8 = 0 THEN 'G'
         WHEN event_type='purchase' THEN 'T' ELSE 'D' END AS kind,
    concat('KX', user_id % 10, '-E', user_id % 50, '-T', user_id) AS ticker,
    CAST(user_id % 4 AS SMALLINT) AS conn_id, 1 AS sid,
    epoch_us(ts) * 1000 AS recv_wall_ns,
    epoch_us(ts) * 1000 - 1704067200000000000 AS recv_mono_ns,
    epoch_us(ts) // 1000 AS ts_ms,
    CAST(CASE WHEN event_type IN ('view','error') THEN 1 ELSE 0 END AS TINYINT) AS side,
    CAST(CASE WHEN event_id % 401 = 0 THEN 5500
         WHEN event_type IN ('view','error') THEN 5100 + 100*(event_id % 10)
         ELSE 4000 + 100*(event_id % 10) END AS INTEGER) AS price_e4,
    CASE WHEN event_id % 503 = 0 THEN -10000000
         WHEN event_id % 3 = 0 THEN -CAST(round(value*100) AS BIGINT)
         ELSE CAST(round(value*100) AS BIGINT) END AS delta_e2,
    CAST(round(value*100) AS BIGINT) AS size_e2
  FROM events)"""

SNAPSHOTS_SQL = """snaps AS (
  SELECT f.*, CAST(CASE WHEN k < 10 THEN 0 ELSE 1 END AS TINYINT) AS lv_side,
    CAST(CASE WHEN k < 10 THEN 4000 + 100*k ELSE 5100 + 100*(k-10) END AS INTEGER) AS lv_price,
    100000 + size_e2 AS lv_count
  FROM feed f, range(20) r(k) WHERE kind = 'S')"""

TRADES_SQL = """trades AS (
  SELECT ticker, concat('t', event_id) AS trade_id, ts_ms, recv_wall_ns, recv_mono_ns, conn_id,
    sid, event_id AS seq, CAST(4000 + 100*(event_id % 21) AS INTEGER) AS price_e4,
    size_e2 AS count_e2, CAST(event_id % 2 AS TINYINT) AS taker_side,
    event_id % 50 = 0 AS is_block
  FROM feed WHERE kind = 'T')"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed markets: series from the brand, event from the type, volume from sales.

    Every seventh part is listed twice with an older volume, as pages shifting mid-listing do.
    """
    part = table(spark, sf_dir, "part")
    sold = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sold"))
    )
    series = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    event = F.concat(
        series, F.lit("-"), F.upper(F.regexp_replace("p_type", "[^A-Za-z0-9]", ""))
    )
    key = F.col("p_partkey")
    bid = F.when(key % 5 != 0, ((key * 37) % 9_000).cast("int") + 100)
    first = part.join(sold, part.p_partkey == sold.l_partkey, "left").select(
        F.concat(event, F.lit("-T"), key.cast("string")).alias("ticker"),
        series.alias("series_ticker"),
        event.alias("event_ticker"),
        F.lit(0).alias("exchange_index"),
        F.when(key % 11 == 0, "closed").otherwise("active").alias("status"),
        (F.coalesce("sold", F.lit(0)) * 100).cast("bigint").alias("volume_24h"),
        F.when(key % 13 != 0, F.lit(DAY_2024_S) + (key % 240) * 3_600 - 36_000).alias("close_ts"),
        (key % 17 == 0).alias("is_mve"),
        F.when(key % 3 == 0, "greater").when(key % 3 == 1, "between").alias("strike_type"),
        bid.alias("yes_bid"),
        F.when(key % 7 != 0, bid + 100).alias("yes_ask"),
        F.when(key % 2 == 0, ((key * 53) % 9_900).cast("int") + 50).alias("last_price"),
        key.alias("p_partkey"),
    )
    again = first.where(key % 7 == 0).withColumn(
        "volume_24h", F.greatest(F.lit(0), F.col("volume_24h") - 100)
    )
    names = [f.name for f in schemas.LISTING.fields]
    return first.unionByName(again).select(*names)


LISTING_SQL = """sold AS (
  SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS sold FROM lineitem GROUP BY 1),
keyed AS (
  SELECT p_partkey AS k, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS series,
    upper(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS typ, coalesce(sold, 0) AS sold
  FROM part LEFT JOIN sold ON p_partkey = l_partkey),
first_pass AS (
  SELECT k, concat(series, '-', typ, '-T', k) AS ticker, series AS series_ticker,
    concat(series, '-', typ) AS event_ticker, 0 AS exchange_index,
    CASE WHEN k % 11 = 0 THEN 'closed' ELSE 'active' END AS status,
    CAST(sold * 100 AS BIGINT) AS volume_24h,
    CASE WHEN k % 13 <> 0 THEN 1704067200 + (k % 240) * 3600 - 36000 END AS close_ts,
    k % 17 = 0 AS is_mve,
    CASE WHEN k % 3 = 0 THEN 'greater' WHEN k % 3 = 1 THEN 'between' END AS strike_type,
    CASE WHEN k % 5 <> 0 THEN CAST((k * 37) % 9000 + 100 AS INTEGER) END AS yes_bid,
    CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN CAST((k * 37) % 9000 + 200 AS INTEGER) END AS yes_ask,
    CASE WHEN k % 2 = 0 THEN CAST((k * 53) % 9900 + 50 AS INTEGER) END AS last_price
  FROM keyed),
listing AS (
  SELECT * EXCLUDE (k) FROM first_pass
  UNION ALL
  SELECT * EXCLUDE (k) REPLACE (greatest(0, volume_24h - 100) AS volume_24h)
  FROM first_pass WHERE k % 7 = 0)"""


def write_segments(raw: DataFrame, root: str) -> None:
    """Write sample records as segment files under ``root``, each by the task that holds its rows.

    Tasks write whole files to paths that depend on the segment alone, so a task that runs again writes the
    same file again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        from bookstrata.sources import segments as layout

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        name, file, packed = None, None, None

        def close() -> None:
            if file is not None:
                file.write(packed.flush())
                file.close()

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.segment != name:
                    close()
                    name = r.segment
                    system.create_dir(f"{base}/{name.rsplit('/', 1)[0]}", recursive=True)
                    file, packed = system.open_output_stream(f"{base}/{name}", compression=None), zstandard.ZstdCompressor(level=3).compressobj()
                    header = json.dumps({"conn_id": int(r.conn_id), "use_yes_price": bool(r.use_yes_price), "subscriptions": []}).encode()
                    file.write(packed.compress(layout.FILE_HEADER.pack(layout.MAGIC, layout.FORMAT_VERSION, len(header)) + header))
                head = layout.RECORD_HEADER.pack(r.kind, r.conn_id, r.recv_mono_ns, r.recv_wall_ns, len(r.payload))
                file.write(packed.compress(head + r.payload))
            yield pd.DataFrame({"rows": [len(batch)]})
        close()

    laid = raw.repartition("segment").sortWithinPartitions("segment", "ordinal")
    laid.mapInPandas(write, "rows bigint").agg(F.sum("rows")).collect()
