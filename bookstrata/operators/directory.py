"""Market list, details and recorder health, as joins over the latest known facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_MS, NS_PER_S
from bookstrata.functions.exact import floor_div
from bookstrata.functions.markets import ENDED_EVENTS, MOVED_EVENT, book_state, is_open
from bookstrata.operators.books import API_DEPTH, book_images

MAX_TOP = 200
DEFAULT_TOP = 50
RECORDING_INTERVALS = 2
UNPRICED_TRIES = 4


def latest_tickers(updates: DataFrame, order: str = "recv_mono_ns") -> DataFrame:
    """Last update per market by arrival."""
    rest = [c for c in updates.columns if c != "ticker"]
    return updates.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.col(order)).alias("u")).select("ticker", "u.*")


def latest_catalog(catalog: DataFrame, version: str = "catalog_version") -> DataFrame:
    """The newest catalog whole; each version replaces the one before it."""
    newest = catalog.agg(F.max(version).alias("v")).scalar()
    return catalog.where(F.col(version) == newest)


def lifecycle_state(events: DataFrame) -> DataFrame:
    """Per market: whether it was determined or settled, and its last moved close time."""
    kind = F.col("event_type")
    moved = F.when((kind == MOVED_EVENT) & F.col("close_ts").isNotNull(), F.struct("recv_wall_ns", "seq"))
    return events.groupBy("ticker").agg(
        F.bool_or(kind.isin(*ENDED_EVENTS)).alias("ended"),
        F.max_by("close_ts", moved).alias("moved_close_ts"),
    )


def as_last_reported(markets: DataFrame, state: DataFrame) -> DataFrame:
    """Markets without those that ended, with moved close times in place of listed ones."""
    joined = markets.join(state.select("ticker", "ended", "moved_close_ts"), "ticker", "left")
    kept = joined.where(~F.coalesce("ended", F.lit(False)))
    return kept.withColumn("close_ts", F.coalesce("moved_close_ts", "close_ts")).drop("ended", "moved_close_ts")


def market_rows(
    catalog: DataFrame,
    tickers: DataFrame,
    state: DataFrame,
    metadata: DataFrame,
    book_status: DataFrame,
) -> DataFrame:
    """One row per catalog market with everything known about it; missing facts are NULL."""
    joined = (
        catalog.join(tickers.select("ticker", "bid_e4", "ask_e4", "last_e4"), "ticker", "left")
        .join(state, "ticker", "left")
        .join(metadata.select("ticker", "title", "subtitle", "category"), "ticker", "left")
        .join(book_status.select("ticker", "stale", F.lit(True).alias("has_book")), "ticker", "left")
    )
    return joined.select(
        "ticker", "event_ticker", "series_ticker", "title", "subtitle", "category", "showcase",
        F.col("volume_24h").alias("volume_24h_e2"),
        F.coalesce("moved_close_ts", "close_ts").alias("close_ts"), "bid_e4", "ask_e4", "last_e4",
        book_state(F.col("has_book"), F.col("stale")).alias("book"),
        F.coalesce("ended", F.lit(False)).alias("ended"),
    )


def market_details(rows: DataFrame, levels: DataFrame, price_ranges: DataFrame, status: DataFrame) -> DataFrame:
    """Market rows with their price grid and the top levels of their book."""
    images = book_images(levels, API_DEPTH)
    return (
        rows.join(price_ranges.select("ticker", "price_ranges"), "ticker", "left")
        .join(status.select("ticker", F.col("last_ts_ms").alias("depth_ts_ms")), "ticker", "left")
        .join(images, "ticker", "left")
    )


def top_markets(rows: DataFrame, limit: int = DEFAULT_TOP, now_ts: int = 0) -> DataFrame:
    """Open markets by 24-hour volume, then ticker."""
    if not 1 <= limit <= MAX_TOP:
        raise ValueError(f"limit must be 1..{MAX_TOP}")
    open_now = rows.where(is_open(F.col("close_ts"), F.col("ended"), now_ts))
    return open_now.orderBy(F.col("volume_24h_e2").desc(), "ticker").limit(limit)


def quote_fallback(rows: DataFrame, books: DataFrame, tickers: DataFrame) -> DataFrame:
    """Header quotes: the local book, else the latest update, else the listed row."""
    joined = rows.join(
        books.select("ticker", F.col("best_bid").alias("b1"), F.col("best_ask").alias("a1")), "ticker", "left"
    ).join(
        tickers.select("ticker", F.col("bid_e4").alias("b2"), F.col("ask_e4").alias("a2"), F.col("last_e4").alias("l2")),
        "ticker", "left",
    )
    return joined.select(
        "ticker", F.coalesce("b1", "b2", "bid_e4").alias("bid"),
        F.coalesce("a1", "a2", "ask_e4").alias("ask"), F.coalesce("l2", "last_e4").alias("last"),
    )


def recorder_health(reports: DataFrame, now_mono_ns: int) -> DataFrame:
    """The latest report and whether it is recent enough to count as recording."""
    latest = reports.agg(F.max_by(F.struct(*reports.columns), "received_mono_ns").alias("r")).select("r.*")
    age = F.lit(now_mono_ns) - F.col("received_mono_ns")
    return latest.select(
        "*", (age <= F.col("interval_s").cast("bigint") * RECORDING_INTERVALS * NS_PER_S).alias("recording"),
        floor_div(age, NS_PER_MS).alias("age_ms"),
    )


def check_subscription(asked: DataFrame, catalog: DataFrame, max_tickers: int) -> DataFrame:
    """Accept or reject each asked ``(session, pos, ticker)``; repeats count once.

    Unknown markets are rejected; of the known ones only the first ``max_tickers`` are accepted.
    """
    once = asked.groupBy("session", "ticker").agg(F.min("pos").alias("pos"))
    known = catalog.select("ticker").distinct().withColumn("known", F.lit(True))
    order = Window.partitionBy("session", F.col("known").isNotNull()).orderBy("pos")
    ranked = once.join(known, "ticker", "left").withColumn("nth", F.row_number().over(order))
    code = F.when(F.col("known").isNull(), "unknown_ticker").when(
        F.col("nth") > max_tickers, "too_many_tickers"
    )
    return ranked.select("session", "ticker", "pos", code.alias("rejected"))
