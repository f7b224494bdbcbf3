"""Views and comparisons of books held as level rows ``(ticker, side, price_e4, count_e2)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.levels import checksum_of, level_mix64
from bookstrata.operators.replay import ASK, BID, EMPTY, Books

API_DEPTH = 20
LADDER_DEPTH = 10


def _best_first() -> Column:
    """Sort key that puts the best price of either side first."""
    return F.when(F.col("side") == BID, -F.col("price_e4")).otherwise(F.col("price_e4"))


def top_of_book(levels: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Best prices, their sizes and level counts; sizes and counts are zero where a side is empty."""
    bid, ask = F.col("side") == BID, F.col("side") == ASK
    price, count = F.col("price_e4"), F.col("count_e2")
    return levels.groupBy(*keys).agg(
        F.max(F.when(bid, price)).alias("best_bid"),
        F.coalesce(F.max_by(count, F.when(bid, price)), F.lit(0)).alias("bid_size"),
        F.min(F.when(ask, price)).alias("best_ask"),
        F.coalesce(F.min_by(count, F.when(ask, price)), F.lit(0)).alias("ask_size"),
        F.count(F.when(bid, 1)).alias("bid_levels"),
        F.count(F.when(ask, 1)).alias("ask_levels"),
    )


def book_summary(books: Books) -> DataFrame:
    """Top of book for every market, books without levels included."""
    top = top_of_book(books.levels)
    zero = F.lit(0)
    return books.status.join(top, "ticker", "left").select(
        "ticker", "stale", "last_ts_ms", "best_bid",
        F.coalesce("bid_size", zero).alias("bid_size"), "best_ask",
        F.coalesce("ask_size", zero).alias("ask_size"),
        F.coalesce("bid_levels", zero).alias("bid_levels"),
        F.coalesce("ask_levels", zero).alias("ask_levels"),
    )


def size_at(levels: DataFrame, asked: DataFrame) -> DataFrame:
    """Resting count at asked ``(ticker, side, price_e4)``; zero where no level rests."""
    keys = ["ticker", "side", "price_e4"]
    found = asked.join(levels.select(*keys, "count_e2"), keys, "left")
    return found.withColumn("count_e2", F.coalesce("count_e2", F.lit(0)))


def ranked_levels(levels: DataFrame) -> DataFrame:
    """Every level with its rank from the best price on its side, from 1."""
    side = Window.partitionBy("ticker", "side").orderBy(_best_first())
    return levels.withColumn("rank", F.row_number().over(side))


def depth(levels: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` levels per side, best first."""
    if n < 0:
        raise ValueError("depth must be non-negative")
    return ranked_levels(levels).where(F.col("rank") <= n)


def level_array(side: int, limit: int | None = None) -> Column:
    """Aggregate: one side's levels as an array of (price, count), best first.

    A book holds at most one level per price of the grid, so the array is bounded.
    """
    item = F.struct(F.col("price_e4"), F.col("count_e2"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("side") == side, item)), asc=side == ASK)
    return ordered if limit is None else F.slice(ordered, 1, limit)


def book_images(levels: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per market with ``bids`` and ``asks`` arrays, best first."""
    return levels.groupBy("ticker").agg(
        level_array(BID, limit).alias("bids"), level_array(ASK, limit).alias("asks")
    )


def ladder(levels: DataFrame, n: int = LADDER_DEPTH) -> DataFrame:
    """Top levels with each market's spread and each level's share of the largest shown size."""
    market = Window.partitionBy("ticker")
    shown = depth(levels, n)
    bid = F.max(F.when(F.col("side") == BID, F.col("price_e4"))).over(market)
    ask = F.min(F.when(F.col("side") == ASK, F.col("price_e4"))).over(market)
    largest = F.greatest(F.lit(1), F.max("count_e2").over(market))
    share = F.greatest(F.lit(2.0), F.col("count_e2") / largest * 100.0)
    return shown.select(
        "ticker", "side", "rank", "price_e4", "count_e2", (ask - bid).alias("spread_e4"),
        share.alias("bar_pct"),
    )


def book_checksums(levels: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Order-independent 64-bit checksum of each book's levels."""
    hashed = levels.withColumn("h", level_mix64("side", "price_e4", "count_e2"))
    return hashed.groupBy(*keys).agg(checksum_of("h").alias("checksum"))


def diff_books(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Levels whose counts differ between two sets of books; an absent level counts zero."""
    on = [*keys, "side", "price_e4"]
    zero = F.lit(0).cast("bigint")
    both = a.select(*on, F.col("count_e2").alias("count_a")).join(
        b.select(*on, F.col("count_e2").alias("count_b")), on, "full"
    )
    filled = both.select(
        *on,
        F.coalesce("count_a", zero).alias("count_a"),
        F.coalesce("count_b", zero).alias("count_b"),
    )
    return filled.where(F.col("count_a") != F.col("count_b"))


def diff_summary(diff: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Number of differing levels and the largest absolute difference."""
    return diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mismatched_levels"),
        F.max(F.abs(F.col("count_a") - F.col("count_b"))).alias("max_abs_diff_e2"),
    )


def to_keyframe(books: Books, as_of_ns: int) -> DataFrame:
    """Books as keyframe rows: one per level, one ``side=-1`` row for a book without levels."""
    held = books.status.join(books.levels, "ticker", "left")
    return held.select(
        "ticker",
        F.coalesce("side", F.lit(EMPTY)).cast("tinyint").alias("side"),
        F.coalesce("price_e4", F.lit(0)).cast("int").alias("price_e4"),
        F.coalesce("count_e2", F.lit(0)).cast("bigint").alias("count_e2"),
        F.lit(as_of_ns).cast("bigint").alias("as_of_recv_ns"),
        F.col("last_ts_ms").cast("bigint").alias("last_ts_ms"),
        "stale",
    )


def keyframe_agreement(rebuilt: Books, keyframe: DataFrame) -> DataFrame:
    """Per market, whether rebuilt levels and flag equal a recorded keyframe's."""
    recorded = keyframe.groupBy("ticker").agg(F.max("stale").alias("recorded_stale"))
    wrong = diff_books(rebuilt.levels, keyframe.where(F.col("side") >= 0))
    counts = wrong.groupBy("ticker").agg(F.count(F.lit(1)).alias("differences"))
    joined = recorded.join(rebuilt.status, "ticker", "full").join(counts, "ticker", "left")
    differences = F.coalesce("differences", F.lit(0))
    same_flag = F.col("stale").eqNullSafe(F.col("recorded_stale"))
    return joined.select(
        "ticker", differences.alias("differences"), same_flag.alias("same_flag"),
        ((differences == 0) & same_flag).alias("agrees"),
    )


