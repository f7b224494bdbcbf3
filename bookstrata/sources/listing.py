"""Saved REST pages as typed tables: market listings, series, books, trades, candles, fee changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.functions.exact import PRICE_SCALE, number_problem, parse_count, parse_price
from bookstrata.functions.markets import (
    close_ts_problem,
    parse_close_ts,
    parse_quote,
    quote_problem,
    series_of,
)

MARKET = (
    "ticker STRING, event_ticker STRING, status STRING, close_time STRING, volume_24h_fp STRING, "
    "yes_bid_dollars STRING, yes_ask_dollars STRING, last_price_dollars STRING, "
    "exchange_index INT, strike_type STRING, yes_sub_title STRING, "
    "price_ranges ARRAY<STRUCT<start: STRING, end: STRING, step: STRING>>"
)
MARKETS_PAGE = f"markets ARRAY<STRUCT<{MARKET}>>, cursor STRING"
SERIES_PAGE = (
    "series ARRAY<STRUCT<ticker STRING, title STRING, category STRING, fee_type STRING, "
    "fee_multiplier DOUBLE>>"
)
EVENTS_PAGE = (
    "events ARRAY<STRUCT<event_ticker STRING, series_ticker STRING, title STRING, "
    "sub_title STRING, fee_type_override STRING, fee_multiplier_override DOUBLE>>, cursor STRING"
)
ORDERBOOKS_PAGE = (
    "orderbooks ARRAY<STRUCT<ticker STRING, orderbook_fp STRUCT<yes_dollars "
    "ARRAY<ARRAY<STRING>>, no_dollars ARRAY<ARRAY<STRING>>>>>"
)
TRADES_PAGE = (
    "trades ARRAY<STRUCT<trade_id STRING, ticker STRING, count_fp STRING, yes_price_dollars STRING, "
    "no_price_dollars STRING, taker_book_side STRING, created_time STRING, "
    "is_block_trade BOOLEAN>>, cursor STRING"
)
FEE_CHANGES_PAGE = (
    "series_fee_change_arr ARRAY<STRUCT<id STRING, series_ticker STRING, fee_type STRING, "
    "fee_multiplier DOUBLE, scheduled_ts STRING>>"
)
_OFFER = "STRUCT<open_dollars STRING, low_dollars STRING, high_dollars STRING, close_dollars STRING>"
CANDLES_PAGE = (
    "markets ARRAY<STRUCT<market_ticker STRING, candlesticks ARRAY<STRUCT<end_period_ts BIGINT, "
    f"yes_bid {_OFFER}, yes_ask {_OFFER}, price {_OFFER}, volume_fp STRING, "
    "open_interest_fp STRING>>>>"
)


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved pages, one JSON document per file or line, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def markets_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.inline("markets"))


def convert_markets(markets: DataFrame, is_mve: bool = False) -> DataFrame:
    """Listed markets in fixed point, with ``problem`` set where one does not convert."""
    problem = F.coalesce(
        F.when(F.col("ticker").isNull() | F.col("event_ticker").isNull(), F.lit("missing ticker")),
        number_problem("volume_24h_fp", 2),
        F.when(parse_count("volume_24h_fp").isNull(), F.lit("negative volume")),
        close_ts_problem("close_time"),
        quote_problem("yes_bid_dollars"),
        quote_problem("yes_ask_dollars"),
        quote_problem("last_price_dollars"),
    )
    return markets.select(
        "ticker", series_of("ticker").alias("series_ticker"), "event_ticker",
        F.coalesce("exchange_index", F.lit(0)).alias("exchange_index"), "status",
        parse_count("volume_24h_fp").alias("volume_24h"),
        parse_close_ts("close_time").alias("close_ts"), F.lit(is_mve).alias("is_mve"),
        "strike_type", parse_quote("yes_bid_dollars", 0).alias("yes_bid"),
        parse_quote("yes_ask_dollars", PRICE_SCALE).alias("yes_ask"),
        parse_quote("last_price_dollars", 0).alias("last_price"), problem.alias("problem"),
    )


def readable(converted: DataFrame) -> DataFrame:
    return converted.where(F.col("problem").isNull()).drop("problem")


def listing_report(converted: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Markets read and skipped, one reason, and whether the last page still had a cursor."""
    counts = converted.agg(
        F.count(F.when(F.col("problem").isNull(), 1)).alias("markets"),
        F.count("problem").alias("unreadable"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("ticker"))).alias("first_error"),
    )
    if pages is None:
        return counts
    open_pages = pages.agg((F.count(F.when(F.coalesce("cursor", F.lit("")) == "", 1)) == 0).alias("t")).scalar()
    return counts.withColumn("truncated", open_pages)


def of_series(converted: DataFrame, requested: Sequence[str], asked: str = "requested_series") -> DataFrame:
    """Only markets of the series their own page was asked for."""
    return converted.where(F.col("series_ticker") == F.col(asked)).where(
        F.col("series_ticker").isin(*dict.fromkeys(requested))
    )


def series_categories(series: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Series under the category each reports, for the wanted categories.

    ``version`` and ``complete`` mark fetches; only the newest complete one counts, so a failed
    fetch keeps the last map whole.
    """
    newest = series.where("complete").agg(F.max("version").alias("v")).scalar()
    latest = series.where(F.col("complete") & (F.col("version") == newest))
    kept = latest.where(F.col("category").isin(*wanted))
    return kept.groupBy(F.col("ticker").alias("series_ticker")).agg(F.max("category").alias("category"))


def orderbooks(pages: DataFrame) -> DataFrame:
    """REST books as ``(ticker, yes_dollars, no_dollars)``."""
    books = pages.select(F.inline("orderbooks"))
    return books.select("ticker", "orderbook_fp.yes_dollars", "orderbook_fp.no_dollars")


def rest_trades(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.inline("trades"))
    return rows.select(
        "trade_id", "ticker", parse_count("count_fp").alias("count_e2"),
        parse_price("yes_price_dollars").alias("price_e4"),
        F.when(F.col("taker_book_side") == "bid", 0).otherwise(1).cast("byte").alias("taker_side"),
        F.unix_millis(F.try_to_timestamp("created_time")).alias("created_ms"),
        F.coalesce("is_block_trade", F.lit(False)).alias("is_block"),
    )


def fee_changes(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.inline("series_fee_change_arr"))
    return rows.withColumn("scheduled_ts", F.unix_seconds(F.try_to_timestamp("scheduled_ts")))


def candles(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.inline("markets")).select("market_ticker", F.inline("candlesticks"))
    price = F.col("price")
    return rows.select(
        F.col("market_ticker").alias("ticker"), "end_period_ts",
        parse_price(price["open_dollars"]).alias("open_e4"), parse_price(price["high_dollars"]).alias("high_e4"),
        parse_price(price["low_dollars"]).alias("low_e4"), parse_price(price["close_dollars"]).alias("close_e4"),
        parse_count("volume_fp").alias("volume_e2"),
    )
