"""Measures over trades and books: candles, fees, reconciliation, markouts and flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_MINUTE
from bookstrata.functions.exact import PRICE_SCALE, div_ceil, floor_div, notional_e6
from bookstrata.operators.ordering import ranked, restart_boundaries, with_stretch
from bookstrata.operators.replay import Timeline
from bookstrata.operators.running import Running, asof_join, running
from bookstrata.session import materialize

CANDLE_MS = 60_000
# Block width of as-of lookups; the time axis is monotonic nanoseconds.
BLOCK_NS = NS_PER_MINUTE


def trade_candles(trades: DataFrame, width_ms: int = CANDLE_MS) -> DataFrame:
    """Open, high, low, close and volume per market and period, from trades in exchange order."""
    order = F.struct("ts_ms", "seq", "trade_id")
    start = floor_div("ts_ms", width_ms) * width_ms
    return trades.groupBy("ticker", start.alias("start_ms")).agg(
        F.min_by("price_e4", order).alias("open_e4"), F.max("price_e4").alias("high_e4"),
        F.min("price_e4").alias("low_e4"), F.max_by("price_e4", order).alias("close_e4"),
        F.sum("count_e2").alias("volume_e2"), F.count(F.lit(1)).alias("trades"),
    )


def candle_agreement(ours: DataFrame, listed: DataFrame, fields: tuple[str, ...] = ("open_e4", "high_e4", "low_e4", "close_e4", "volume_e2")) -> DataFrame:
    """Candles on either side and how many agree in every field."""
    key = ["ticker", "start_ms"]
    both = ours.select(*key, F.struct(*fields).alias("a")).join(
        listed.select(*key, F.struct(*fields).alias("b")), key, "full"
    )
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") == F.col("b"))
    return both.agg(
        F.count(F.when(same, 1)).alias("agreeing"), F.count(F.lit(1)).alias("candles"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("only_ours"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("only_listed"),
    )


# What makers pay of the taker's rate, by fee type, in quarters.
MAKER_QUARTERS = {"quadratic": 0, "quadratic_with_maker_fees": 1, "quadratic_with_combo_maker_fees": 2}


def trade_fees(trades: DataFrame, fee_changes: DataFrame, block_ms: int = 3_600_000, maker: bool = False) -> DataFrame:
    """Taker fee of each trade, or the maker's, under the regime in force when it happened.

    ``fee_changes`` holds ``(series_ticker, effective_ms, rate_num, rate_den)`` with the taker's rate, and for
    makers ``fee_type``; a type without maker fees gives 0.
    """
    keyed = trades.withColumn("series_ticker", F.substring_index("ticker", "-", 1))
    found = asof_join(
        keyed, fee_changes, ["series_ticker"], F.col("ts_ms"), F.col("effective_ms"),
        floor_div("ts_ms", block_ms), floor_div("effective_ms", block_ms),
        ["rate_num", "rate_den", *(["fee_type"] if maker else [])],
    )
    product = (
        F.col("rate_num").cast("bigint") * F.col("count_e2") * F.col("price_e4")
        * (F.lit(PRICE_SCALE) - F.col("price_e4"))
    )
    quarters = F.lit(4)
    if maker:
        quarters = F.lit(0)
        for name, n in MAKER_QUARTERS.items():
            quarters = F.when(F.col("fee_type") == name, n).otherwise(quarters)
    # Cents: rate x (count/100) x (p/10^4) x (q/10^4) x 100.
    cents = div_ceil(product * quarters, F.col("rate_den").cast("bigint") * 400_000_000)
    return found.withColumn("fee_e6", cents * 10_000)


def quotes_at_trades(trades: DataFrame, line: Timeline) -> DataFrame:
    """Each trade with the best prices of its market just before it was received."""
    quotes = line.top_of_book().select("ticker", "mono", "best_bid", "best_ask", "pos")
    quotes = quotes.groupBy("ticker", "mono").agg(
        F.max_by(F.struct("best_bid", "best_ask"), "pos").alias("q")
    ).select("ticker", "mono", "q.best_bid", "q.best_ask")
    # The join reads its rows twice.
    quotes = materialize(quotes, "quotes")
    return asof_join(
        trades, quotes, ["ticker"], F.col("recv_mono_ns"), F.col("mono"),
        floor_div("recv_mono_ns", BLOCK_NS), floor_div("mono", BLOCK_NS), ["best_bid", "best_ask"],
        allow_equal=False,
    )


def impossible_trades(quoted: DataFrame) -> DataFrame:
    """Trades through the book per market: a taker bought below the ask or sold above the bid."""
    buy = F.col("taker_side") == 0
    wrong = F.when(buy, F.col("price_e4") < F.col("best_ask")).otherwise(F.col("price_e4") > F.col("best_bid"))
    judged = F.when(buy, F.col("best_ask")).otherwise(F.col("best_bid")).isNotNull() & F.col("found_at").isNotNull()
    return quoted.groupBy("ticker").agg(
        F.count(F.when(judged & wrong, 1)).alias("impossible"), F.count(F.when(judged, 1)).alias("judged")
    )


def reconcile_trades(recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """Trades by whether both sources hold them with equal price, count and side."""
    fields = F.struct("ticker", "price_e4", "count_e2", "taker_side")
    both = recorded.select("trade_id", fields.alias("a")).join(listed.select("trade_id", fields.alias("b")), "trade_id", "full")
    state = (
        F.when(F.col("b").isNull(), "only_recorded").when(F.col("a").isNull(), "only_listed")
        .when(F.col("a") == F.col("b"), "equal").otherwise("different")
    )
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("trades"))


def capped_slice(rows: DataFrame, order: list[str], cap: int | None = None) -> DataFrame:
    """All rows in order, or the first ``cap`` if the caller asks for a number, each saying whether more exist."""
    if cap is None:
        return rows.orderBy(*order).withColumn("truncated", F.lit(False))
    more = rows.agg((F.count(F.lit(1)) > cap).alias("more")).scalar()
    return rows.orderBy(*order).limit(cap).withColumn("truncated", more)


def ordered_stream(streams: dict[str, DataFrame]) -> DataFrame:
    """Several event tables as one stream in receive order."""
    out = None
    for rank, (kind, rows) in enumerate(streams.items()):
        tagged = rows.withColumn("stream", F.lit(kind)).withColumn("stream_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.orderBy("recv_mono_ns", "stream_rank")


def merged_stream(streams: dict[str, DataFrame]) -> DataFrame:
    """Several event tables as one stream in receive order, numbered from 0 as ``position``, across host restarts.

    Each table has ``recv_wall_ns``, ``recv_mono_ns`` and ``seq``, and may have ``ts_ms``. Host boots come in order,
    then monotonic times; at one reading the tables in the order given, and rows of one table in its stored order. No
    task sees more than its range of the stream, and ``start`` of a later read is a filter on ``position``.
    """
    out = None
    for source, (kind, rows) in enumerate(streams.items()):
        if "ts_ms" not in rows.columns:
            rows = rows.withColumn("ts_ms", F.lit(None).cast("bigint"))
        tagged = rows.withColumn("stream", F.lit(kind)).withColumn("src", F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    boundaries = restart_boundaries(out, "recv_wall_ns", "recv_mono_ns", "src")
    out = with_stretch(out, boundaries, "recv_wall_ns", "recv_mono_ns", "src")
    last = F.lit((1 << 63) - 1)
    order = F.struct("stretch", "recv_mono_ns", "src", F.coalesce("ts_ms", last).alias("k_ts"), F.coalesce("seq", last).alias("k_seq"), "recv_wall_ns")
    out = ranked(out.withColumn("order", order), [], "order", "stream")
    return out.withColumnRenamed("rank", "position").drop("order", "src")


def profit_and_loss(fills: DataFrame, settlements: DataFrame) -> DataFrame:
    """Cash per market: settlement value of the final position, less what fills cost and fees.

    Fills are ``(ticker, price_e4, count_e2, taker_side, fee_e6)`` with side 0 for bought.
    """
    sign = F.when(F.col("taker_side") == 0, 1).otherwise(-1)
    by = fills.groupBy("ticker").agg(
        F.sum(sign * F.col("count_e2")).alias("position_e2"),
        F.sum(sign * notional_e6("price_e4", "count_e2")).alias("cost_e6"), F.sum("fee_e6").alias("fees_e6"),
    )
    value = F.col("position_e2") * F.col("value_e4")
    return by.join(settlements, "ticker", "left").select(
        "ticker", "position_e2", "cost_e6", "fees_e6",
        (F.coalesce(value, F.lit(0)) - F.col("cost_e6") - F.col("fees_e6")).alias("pnl_e6"),
    )


def markouts(trades: DataFrame, horizon_ns: int, block_ns: int = BLOCK_NS) -> DataFrame:
    """Price move in the taker's favour from a trade to the first trade a horizon later."""
    later = trades.select("ticker", F.col("recv_mono_ns").alias("mono"), F.col("price_e4").alias("later_e4"))
    due = F.col("recv_mono_ns") + horizon_ns
    found = asof_join(
        trades, later, ["ticker"], due, F.col("mono"), floor_div(due, block_ns),
        floor_div("mono", block_ns), ["later_e4"], forward=True,
    )
    sign = F.when(F.col("taker_side") == 0, 1).otherwise(-1)
    return found.withColumn("markout_e4", sign * (F.col("later_e4") - F.col("price_e4")))


def time_to_fill(orders: DataFrame, trades: DataFrame, block_ns: int = BLOCK_NS, block_e2: int = 1 << 20) -> DataFrame:
    """How long resting orders wait: until the volume traded against their price since then passes what is ahead.

    ``orders`` holds ``(ticker, side, price_e4, placed_ns, ahead_e2)``, with ``ahead_e2`` the contracts up to and
    including the order's own. A taker who buys trades against asks. Cumulated volume only rises, so the first trade
    that reaches a target is an as-of lookup on the axis of volume instead of time. Orders never filled have NULLs.
    """
    key = ["ticker", "side", "price_e4"]
    done = trades.where(F.col("count_e2") > 0).select(
        "ticker", (1 - F.col("taker_side")).cast("int").alias("side"), "price_e4", F.col("recv_mono_ns").alias("mono"), "trade_id", "count_e2"
    )
    done = done.withColumn("block", floor_div("mono", block_ns))
    done = running(done, key, ["block"], ["mono", "trade_id"], {"done_e2": Running("sum", F.col("count_e2"))})
    # As-of joins read both sides twice.
    done = materialize(done.select(*key, "mono", "done_e2"), "done")
    placed = asof_join(
        orders.withColumn("side", F.col("side").cast("int")), done, key, F.col("placed_ns"), F.col("mono"),
        floor_div("placed_ns", block_ns), floor_div("mono", block_ns), ["done_e2"],
    )
    target = F.coalesce("done_e2", F.lit(0)) + F.col("ahead_e2")
    placed = materialize(placed.withColumn("target", target).drop("found_at", "done_e2"), "placed")
    filled = asof_join(
        placed, done, key, F.col("target"), F.col("done_e2"), floor_div("target", block_e2), floor_div("done_e2", block_e2),
        ["mono"], forward=True,
    )
    return filled.drop("found_at", "target").withColumnRenamed("mono", "filled_ns").withColumn("wait_ns", F.col("filled_ns") - F.col("placed_ns"))


def volume_buckets(trades: DataFrame, bucket_e2: int, block_ns: int = BLOCK_NS) -> DataFrame:
    """Signed flow per volume bucket: trades are cut where cumulative volume passes a multiple."""
    rows = trades.withColumn("block", floor_div("recv_mono_ns", block_ns))
    total = {"done": Running("sum", F.col("count_e2"), current=False)}
    rows = running(rows, ["ticker"], ["block"], ["recv_mono_ns", "trade_id"], total)
    buy = F.col("taker_side") == 0
    return rows.groupBy("ticker", floor_div("done", bucket_e2).alias("bucket")).agg(
        F.sum(F.when(buy, F.col("count_e2")).otherwise(0)).alias("bought_e2"),
        F.sum(F.when(~buy, F.col("count_e2")).otherwise(0)).alias("sold_e2"),
    )


def microprice_e4(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """Size-weighted middle, floored; NULL when a side is empty."""
    weight = bid_size + ask_size
    top = bid.cast("bigint") * ask_size + ask.cast("bigint") * bid_size
    return F.when(bid.isNotNull() & ask.isNotNull() & (weight > 0), F.call_function("div", top, weight))
