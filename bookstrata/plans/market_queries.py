"""Universe selection and market views over the sample listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookstrata.functions import markets as K
from bookstrata.functions.exact import format_count, format_price
from bookstrata.operators import directory as D
from bookstrata.operators import metrics as M
from bookstrata.operators import universe as U
from bookstrata.operators.integrity import green_days, ratio
from bookstrata.plans import shared
from bookstrata.sources import bus, sample
from bookstrata.sources import listing as S
from bookstrata.sources.sample import DAY_2024_S, FEED_SQL, LISTING_SQL, TRADES_SQL

NOW = DAY_2024_S + 7_200
POLICY = U.Policy(
    min_volume_24h=100_000,
    max_markets=60,
    groups=(
        U.Group("near", events=2, markets_per_event=3, series=("BRAND11", "BRAND23", "BRAND7", "NOSUCH"), max_markets=14, market_order="near_price", max_hours_to_close=200),
        U.Group("busy", events=8, markets_per_event=4, category="even"),
        U.Group("more", events=30, markets_per_event=2, category="odd", max_markets=25),
        U.Group("again", events=3, markets_per_event=5, series=("BRAND11", "BRAND12")),
    ),
    max_seconds_to_close=220 * 3_600,
)


def _categories(spark, sf):
    """Series by the parity of their brand number; every fourth series is unknown."""
    series = sample.listing(spark, sf).select("series_ticker").distinct()
    number = F.regexp_extract("series_ticker", "([0-9]+)", 1).cast("int")
    known = series.where(number % 4 != 3)
    return known.select("series_ticker", F.when(number % 2 == 0, "even").otherwise("odd").alias("category"))


def _decision(spark, sf):
    def make():
        decision = U.select(sample.listing(spark, sf), POLICY, NOW, _categories(spark, sf))
        return decision, [decision.chosen]

    return shared.once(spark, sf, "universe", make)


def universe_chosen(spark, sf):
    rows = _decision(spark, sf).chosen
    return rows.select("group", "ticker", "pos", "place", "admitted", "showcase")


def universe_reasons(spark, sf):
    return _decision(spark, sf).reason_counts()


def universe_groups(spark, sf):
    return _decision(spark, sf).group_counts()


def universe_pinned(spark, sf):
    """The decision repeated an hour later with the first two groups pinned to fixed lists."""
    first = sample.listing(spark, sf).where(F.col("series_ticker") == "BRAND23")
    # A pin list is what one group admitted: bounded by the group's caps.
    pins = [r.ticker for r in first.select("ticker").distinct().orderBy("ticker").limit(9).collect()]
    again = U.select(
        sample.listing(spark, sf), POLICY, NOW + 3_600, _categories(spark, sf),
        pinned={"near": [*reversed(pins), *pins], "busy": []},
    )
    return again.chosen.select("group", "ticker", "pos", "place")


def listing_deduped(spark, sf):
    return U.dedupe_listing(sample.listing(spark, sf)).select("ticker", "volume_24h", "extra")


def eligibility(spark, sf):
    rows = U.dedupe_listing(sample.listing(spark, sf))
    return rows.groupBy(F.coalesce(U.rejection(POLICY, NOW), F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("markets"))


def event_totals(spark, sf):
    return U.event_totals(U.dedupe_listing(sample.listing(spark, sf)))


def category_coverage(spark, sf):
    return U.series_per_category(_categories(spark, sf), ["even", "odd", "misspelled"])


def absent_series(spark, sf):
    return U.absent_series(sample.listing(spark, sf), POLICY)


def membership_changes(spark, sf):
    """Assignment by series against assignment an update later, where some markets moved."""
    rows = U.dedupe_listing(sample.listing(spark, sf))
    number = F.regexp_extract("ticker", "T([0-9]+)$", 1).cast("int")
    current = rows.where(number % 5 != 0).select(F.col("series_ticker").alias("group"), "ticker")
    desired = rows.where(number % 6 != 0).select(
        F.when(number % 7 == 0, "moved").otherwise(F.col("series_ticker")).alias("group"), "ticker"
    )
    return U.membership_diff(current, desired)


def rebuilt_groups(spark, sf):
    """Assignments in which some groups change their connection and others all their markets."""
    rows = U.dedupe_listing(sample.listing(spark, sf)).select("series_ticker", "ticker", F.regexp_extract("ticker", "T([0-9]+)$", 1).cast("int").alias("n"))
    series = F.regexp_extract("series_ticker", "([0-9]+)$", 1).cast("int")
    current = rows.where("n % 2 = 0").select(F.col("series_ticker").alias("group"), "ticker", (series % 3).alias("conn_id"))
    desired = rows.where((F.col("n") % 2 == F.when(series % 5 == 0, 1).otherwise(0)) | ((F.col("n") % 9 == 0) & (series % 5 != 0)))
    desired = desired.select(F.col("series_ticker").alias("group"), "ticker", F.when(series % 4 == 0, 7).otherwise(series % 3).alias("conn_id"))
    return U.rebuilt_groups(current, desired)


def requested_series(spark, sf):
    """Markets whose own series is the one their page was asked for; every third page was asked for another."""
    rows = converted_listing(spark, sf)
    n = F.regexp_extract("ticker", "T([0-9]+)$", 1).cast("int")
    rows = rows.withColumn("requested_series", F.when(n % 3 == 0, "BRAND11").otherwise(F.col("series_ticker")))
    return S.of_series(rows, ["BRAND11", "BRAND23", "BRAND11", "NOSUCH"]).select("ticker", "series_ticker")


def audit_rotation(spark, sf):
    """Half of the markets from a cursor that wraps."""
    return U.rotation(sample.feed(spark, sf).select("ticker"), 70, 1_130)


def unpriced_events(spark, sf):
    return U.unpriced_events(_decision(spark, sf), sample.listing(spark, sf))


def converted_listing(spark, sf):
    """The listing written as wire text and converted back, with what does not convert."""
    wire = sample.listing(spark, sf).withColumn("n", F.regexp_extract("ticker", "T([0-9]+)$", 1).cast("int"))
    rows = wire.select(
        "ticker", "event_ticker", "status", "exchange_index", "strike_type",
        F.when(F.col("n") % 19 == 0, "1.005").otherwise(format_count("volume_24h")).alias("volume_24h_fp"),
        F.when(F.col("n") % 23 == 0, "soon").otherwise(F.coalesce(F.date_format(F.timestamp_seconds("close_ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))).alias("close_time"),
        F.coalesce(format_price("yes_bid"), F.lit("0.0000")).alias("yes_bid_dollars"),
        F.coalesce(format_price("yes_ask"), F.lit("1.0000")).alias("yes_ask_dollars"),
        F.coalesce(format_price("last_price"), F.lit("")).alias("last_price_dollars"),
    )
    converted = S.convert_markets(rows)
    return converted.select("ticker", "series_ticker", "volume_24h", "close_ts", "yes_bid", "yes_ask", "last_price", F.col("problem").isNotNull().alias("bad"))


def listing_report(spark, sf):
    rows = converted_listing(spark, sf).select("ticker", F.when(F.col("bad"), "bad").alias("problem"))
    return S.listing_report(rows).select("markets", "unreadable")


def series_categories(spark, sf):
    """Categories of the newest complete fetch only."""
    rows = _categories(spark, sf).select(F.col("series_ticker").alias("ticker"), "category")
    fetches = (
        rows.withColumn("version", F.lit(1)).withColumn("complete", F.lit(True))
        .unionByName(rows.withColumn("category", F.lit("even")).withColumn("version", F.lit(2)).withColumn("complete", F.lit(False)))
    )
    return S.series_categories(fetches, ["even"])


def _tickers(spark, sf):
    """A live update per trade: quotes one cent around the trade."""
    t = sample.trades(spark, sf)
    return t.select(
        "ticker", "recv_mono_ns", (F.col("price_e4") - 100).alias("bid_e4"), (F.col("price_e4") + 100).alias("ask_e4"),
        F.col("price_e4").alias("last_e4"),
    )


def latest_tickers(spark, sf):
    return D.latest_tickers(_tickers(spark, sf)).select("ticker", "bid_e4", "ask_e4", "last_e4")


def _catalog(spark, sf):
    """Feed markets as two catalog versions; the older one is wrong throughout."""
    per = sample.feed(spark, sf).groupBy("ticker").agg(F.sum("size_e2").alias("volume_24h"), F.max("user_id").alias("u"))
    new = per.select(
        "ticker", F.substring_index("ticker", "-", 2).alias("event_ticker"), K.series_of("ticker").alias("series_ticker"),
        "volume_24h", F.when(F.col("u") % 9 != 0, F.lit(DAY_2024_S) + F.col("u") * 3_600).alias("close_ts"),
        (F.col("u") % 2 == 0).alias("showcase"), F.lit(2).alias("catalog_version"),
    )
    old = new.withColumn("volume_24h", F.lit(0).cast("bigint")).withColumn("catalog_version", F.lit(1))
    return D.latest_catalog(new.unionByName(old))


def _lifecycle(spark, sf):
    f = sample.feed(spark, sf).where(F.col("event_type") == "click")
    eid = F.col("event_id")
    kind = F.when(eid % 211 == 0, "determined").when(eid % 7 == 0, "close_date_updated").otherwise("created")
    return f.select(
        "ticker", kind.alias("event_type"), "recv_wall_ns", eid.alias("seq"),
        F.when(eid % 14 != 0, F.lit(DAY_2024_S) + (eid % 1_000) * 3_600).alias("close_ts"),
    )


def lifecycle_state(spark, sf):
    return D.lifecycle_state(_lifecycle(spark, sf))


def open_catalog(spark, sf):
    """Catalog markets still to be shown, with moved close times."""
    return D.as_last_reported(_catalog(spark, sf), lifecycle_state(spark, sf)).select("ticker", "close_ts")


def _rows(spark, sf):
    meta = _catalog(spark, sf).select(
        "ticker", F.concat(F.lit("Title "), "event_ticker").alias("title"), F.lit(None).cast("string").alias("subtitle"),
        F.when(F.col("showcase"), "Sports").alias("category"),
    )
    status = shared.final_books(spark, sf).status
    return D.market_rows(_catalog(spark, sf), latest_tickers(spark, sf), lifecycle_state(spark, sf), meta, status)


def market_rows(spark, sf):
    return _rows(spark, sf).drop("subtitle")


def market_details(spark, sf):
    ranges = _catalog(spark, sf).select("ticker", F.lit(None).cast("string").alias("price_ranges"))
    books = shared.final_books(spark, sf)
    rows = D.market_details(_rows(spark, sf), books.levels, ranges, books.status)
    return rows.select("ticker", "book", "depth_ts_ms", F.size("bids").alias("bids"), F.size("asks").alias("asks"), F.get("bids", F.lit(0))["price_e4"].alias("top_bid"))


def top_markets(spark, sf):
    return D.top_markets(_rows(spark, sf), 50, DAY_2024_S + 40 * 3_600).select("ticker", "volume_24h_e2", "close_ts")


def market_search(spark, sf):
    """Markets whose ticker, title or category contains a text, whatever its case."""
    hit = K.text_matches(["ticker", "title", "subtitle", "category"], "sPORT")
    either = hit | K.text_matches(["ticker", "title"], "e7-")
    return _rows(spark, sf).where(either).select("ticker")


def close_clock(spark, sf):
    now_ms = (DAY_2024_S + 40 * 3_600) * 1_000
    return _catalog(spark, sf).agg(K.last_close_ms("close_ts", now_ms).alias("last_ms"), K.ms_until_next_close("close_ts", now_ms).alias("next_in_ms"))


def recorder_health(spark, sf):
    """Reports every twenty seconds of feed; the latest judged a minute after it arrived."""
    f = sample.feed(spark, sf).select("recv_mono_ns", F.lit(20).alias("interval_s"), F.col("event_id").alias("universe_size"))
    reports = f.withColumnRenamed("recv_mono_ns", "received_mono_ns")
    health = D.recorder_health(reports, 2_592_000_000_000_000)
    return health.select("universe_size", "recording", "age_ms")


def subscription_checks(spark, sf):
    """Every connection asks for the markets of the feed in event order; some are not listed."""
    asked = sample.feed(spark, sf).select(F.col("conn_id").alias("session"), F.col("event_id").alias("pos"), "ticker")
    listed = _catalog(spark, sf).where(F.col("showcase"))
    return D.check_subscription(asked, listed, 10)


def topics(spark, sf):
    """Messages per bus topic family and per control topic."""
    f = sample.feed(spark, sf)
    kind = F.when(F.col("kind") == "G", "gap").when(F.col("event_type") == "click", "lifecycle").when(F.col("kind") == "T", "trade").otherwise("delta")
    rows = f.select("ticker", F.lit(1).alias("bus_epoch"), (F.col("event_id") + 1).alias("bus_seq"), kind.alias("event_type"))
    routed = bus.with_topic(bus.well_formed(rows))
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


# ------------------------------------------------------------------ trade measures


def _line_trades(spark, sf):
    """Order lines as trades: the ship date orders them, the part names the market."""
    li = sample.table(spark, sf, "lineitem")
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    return li.select(
        F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string"), F.lit("-T"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("trade_id"),
        ms.alias("ts_ms"), (ms * 1_000_000).alias("recv_mono_ns"),
        F.col("l_orderkey").alias("seq"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 700) % 9_900 + 50).cast("int").alias("price_e4"),
        (F.col("l_quantity") * 100).cast("bigint").alias("count_e2"), (F.col("l_linenumber") % 2).cast("tinyint").alias("taker_side"),
    )


def trade_candles(spark, sf):
    return M.trade_candles(_line_trades(spark, sf), 86_400_000)


def candle_agreement(spark, sf):
    """Candles against a listing that misses some markets and misstates some volumes."""
    ours = M.trade_candles(sample.trades(spark, sf))
    n = F.regexp_extract("ticker", "T([0-9]+)$", 1).cast("int")
    listed = ours.where(n % 10 != 0).withColumn("volume_e2", F.col("volume_e2") + F.when(n % 11 == 0, 1).otherwise(0))
    return M.candle_agreement(ours, listed)


def trade_fees(spark, sf):
    """Fees per series when each series changes its rate on the first of two months."""
    trades = _line_trades(spark, sf)
    series = trades.select(K.series_of("ticker").alias("series_ticker")).distinct()
    steps = F.array(
        F.struct(F.lit(0).cast("bigint").alias("effective_ms"), F.lit(7).alias("rate_num"), F.lit(100).alias("rate_den")),
        F.struct(F.unix_millis(F.lit("1995-06-01").cast("timestamp")).alias("effective_ms"), F.lit(35).alias("rate_num"), F.lit(1_000).alias("rate_den")),
        F.struct(F.unix_millis(F.lit("2024-01-01").cast("timestamp")).alias("effective_ms"), F.lit(5).alias("rate_num"), F.lit(100).alias("rate_den")),
    )
    fees = M.trade_fees(trades, series.select("series_ticker", F.inline(steps)))
    return fees.groupBy("series_ticker").agg(F.count(F.lit(1)).alias("trades"), F.sum("fee_e6").alias("fee_e6"))


def maker_fees(spark, sf):
    """As ``trade_fees``, for makers: each series has one of the fee types."""
    trades = _line_trades(spark, sf)
    series = trades.select(K.series_of("ticker").alias("series_ticker")).distinct()
    number = F.regexp_extract("series_ticker", "([0-9]+)$", 1).cast("int")
    kinds = F.array(*[F.lit(k) for k in (*M.MAKER_QUARTERS, "flat")])
    changes = series.select(
        "series_ticker", F.lit(0).cast("bigint").alias("effective_ms"), F.lit(7).alias("rate_num"), F.lit(100).alias("rate_den"),
        F.get(kinds, number % 4).alias("fee_type"),
    )
    fees = M.trade_fees(trades, changes, maker=True)
    return fees.groupBy("series_ticker").agg(F.count(F.lit(1)).alias("trades"), F.sum("fee_e6").alias("fee_e6"))


def trade_reconciliation(spark, sf):
    ours = sample.trades(spark, sf)
    n = F.col("seq")
    listed = ours.where(n % 10 != 0).withColumn("count_e2", F.col("count_e2") + F.when(n % 33 == 0, 1).otherwise(0))
    return M.reconcile_trades(ours.where(n % 7 != 0), listed)


def capped_trades(spark, sf):
    rows = sample.trades(spark, sf).select("recv_wall_ns", "trade_id")
    return M.capped_slice(rows, ["recv_wall_ns"], 100)


def whole_slice(spark, sf):
    rows = sample.trades(spark, sf).select("recv_wall_ns", "trade_id")
    return M.capped_slice(rows, ["recv_wall_ns"])


def profit_and_loss(spark, sf):
    fills = _line_trades(spark, sf).withColumn("fee_e6", F.col("count_e2") * 7)
    settle = fills.groupBy("ticker").agg(F.max("price_e4").alias("p")).where(F.col("p") > 9_000).select("ticker", F.lit(10_000).alias("value_e4"))
    return M.profit_and_loss(fills, settle)


def markouts(spark, sf):
    """Average move a day after each trade of the feed, by market."""
    rows = M.markouts(sample.trades(spark, sf), 86_400_000_000_000)
    return rows.groupBy("ticker").agg(F.sum("markout_e4").alias("markout_e4"), F.count("markout_e4").alias("measured"))


def volume_buckets(spark, sf):
    return M.volume_buckets(_line_trades(spark, sf), 50_000, 86_400_000_000_000)


def green_months(spark, sf):
    """Days on which most events were no errors and few were clicks, per month of order lines."""
    f = sample.feed(spark, sf)
    day = F.substring(F.timestamp_micros(F.expr("recv_wall_ns div 1000")).cast("string"), 1, 10)
    good = F.count(F.when(F.col("event_type") != "error", 1))
    clicks = F.count(F.when(F.col("event_type") == "click", 1))
    per = f.groupBy(day.alias("dt")).agg(ratio(good, F.count(F.lit(1))).alias("good"), ratio(clicks, F.count(F.lit(1))).alias("clicks"))
    return green_days(per, {"good": (79, 100, True), "clicks": (21, 100, False)})


QUERIES = {
    f.__name__: f
    for f in (
        universe_chosen, universe_reasons, universe_groups, universe_pinned, listing_deduped,
        eligibility, event_totals, category_coverage, absent_series, membership_changes,
        audit_rotation, unpriced_events, converted_listing, listing_report, series_categories,
        latest_tickers, lifecycle_state, open_catalog, market_rows, market_details, top_markets,
        market_search, close_clock, recorder_health, subscription_checks, topics, trade_candles,
        candle_agreement, trade_fees, maker_fees, rebuilt_groups, requested_series, trade_reconciliation, capped_trades, whole_slice, profit_and_loss,
        markouts, volume_buckets, green_months,
    )
}

# ------------------------------------------------------------------ comparison SQL

_FRESH = """ORDER BY volume_24h DESC, coalesce(close_ts, -1) DESC, status DESC, event_ticker DESC, series_ticker DESC,
  exchange_index DESC, is_mve DESC, coalesce(strike_type, '') DESC, coalesce(yes_bid, -1) DESC, coalesce(yes_ask, -1) DESC,
  coalesce(last_price, -1) DESC"""
_DEDUPED = f"""{LISTING_SQL}, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker {_FRESH}) AS rn,
  count(*) OVER (PARTITION BY ticker) - 1 AS extra FROM listing) WHERE rn = 1)"""


def _why(now: int) -> str:
    return f"""CASE WHEN status <> 'active' THEN 'not_active' WHEN is_mve THEN 'mve' WHEN close_ts <= {now} THEN 'closed'
  WHEN close_ts - {now} > {220 * 3600} THEN 'beyond_horizon' END"""


_CATS = """cats AS (SELECT series_ticker, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM (
  SELECT DISTINCT series_ticker, CAST(regexp_extract(series_ticker, '([0-9]+)', 1) AS INTEGER) AS n FROM listing) WHERE n % 4 <> 3)"""
_MID = "CASE WHEN yes_bid IS NOT NULL AND yes_ask IS NOT NULL THEN (yes_bid + yes_ask) // 2 ELSE last_price END"


def _group_sql(g: U.Group, no: int, earlier: list[str], now: int) -> str:
    """One group's candidates, ranked with correlated counts instead of limits."""
    a = f"g{no}"
    gone = "".join(f" AND ticker NOT IN (SELECT ticker FROM {e})" for e in earlier)
    if g.series is not None:
        names = ", ".join(f"'{s}'" for s in g.series)
        mine, pos = f"series_ticker IN ({names})", f"list_position([{names}], series_ticker)"
        able = "TRUE"
        rank = f"row_number() OVER (PARTITION BY able, series_ticker ORDER BY event_close NULLS LAST, event_ticker)"
    else:
        mine, pos, able = f"category = '{g.category}'", "0", f"event_volume >= {POLICY.min_volume_24h}"
        rank = "row_number() OVER (PARTITION BY able ORDER BY event_volume DESC, event_close NULLS LAST, event_ticker, series_ticker)"
    late = "FALSE"
    if g.max_hours_to_close is not None:
        late = f"coalesce(event_close > {now + g.max_hours_to_close * 3600}, TRUE)"
    order = "volume_24h DESC, close_ts NULLS LAST, ticker"
    if g.market_order == "near_price":
        order = f"CASE WHEN {_MID} IS NULL THEN 1 ELSE 0 END, CASE WHEN thr THEN abs({_MID} - 5000) ELSE 10000 - {_MID} END, {order}"
    cap = "TRUE" if g.max_markets is None else f"pos <= {g.max_markets}"
    return f"""{a}_c AS (SELECT * FROM ok WHERE {mine}{gone}),
{a}_e AS (SELECT *, {rank} AS er FROM (SELECT *, NOT late AND vol_ok AS able FROM (SELECT series_ticker, event_ticker, event_volume,
  event_close, thr, {late} AS late, {able} AS vol_ok FROM (SELECT series_ticker, event_ticker, sum(volume_24h) AS event_volume,
  min(close_ts) AS event_close, bool_and(coalesce(strike_type IN ('greater','greater_or_equal','less','less_or_equal'), FALSE)) AS thr
  FROM {a}_c GROUP BY 1, 2)))),
{a}_m AS (SELECT *, row_number() OVER (PARTITION BY series_ticker, event_ticker ORDER BY {order}) AS mr
  FROM {a}_c JOIN {a}_e USING (series_ticker, event_ticker)),
{a}_p AS (SELECT *, row_number() OVER (ORDER BY {pos}, er, mr) AS pos FROM {a}_m WHERE able AND er <= {g.events} AND mr <= {g.markets_per_event}),
{a} AS (SELECT ticker, series_ticker, event_ticker, '{g.name}' AS "group", {no} AS group_no, CAST(pos AS INTEGER) AS pos,
  {str(g.series is not None).upper()} AS showcase FROM {a}_p WHERE {cap}),
{a}_r AS (SELECT m.ticker, {no} AS group_no, CASE WHEN late THEN 'event_beyond_horizon' WHEN NOT vol_ok THEN 'below_volume'
  WHEN er > {g.events} THEN 'event_not_chosen' WHEN mr > {g.markets_per_event} THEN 'over_markets_per_event'
  ELSE 'over_max_markets' END AS reason FROM {a}_m m WHERE m.ticker NOT IN (SELECT ticker FROM {a}))"""


def _universe_sql(now: int, pins: str | None = None) -> str:
    parts = [f"WITH {_DEDUPED}", _CATS,
             f"ok AS (SELECT dd.*, category FROM dd LEFT JOIN cats USING (series_ticker) WHERE {_why(now)} IS NULL)"]
    earlier: list[str] = []
    for no, g in enumerate(POLICY.groups):
        if pins is not None and no < 2:
            source = pins if no == 0 else "SELECT '' AS ticker, 0 AS pos WHERE FALSE"
            parts.append(f"""g{no} AS (SELECT ok.ticker, series_ticker, event_ticker, '{g.name}' AS "group", {no} AS group_no,
              CAST(p.pos AS INTEGER) AS pos, TRUE AS showcase FROM ok JOIN ({source}) p USING (ticker))""")
        else:
            parts.append(_group_sql(g, no, earlier, now))
        earlier.append(f"g{no}")
    parts.append("chosen AS (SELECT *, row_number() OVER (ORDER BY group_no, pos) AS place FROM ("
                 + " UNION ALL ".join(f"SELECT * FROM {e}" for e in earlier) + "))")
    return ", ".join(parts)


_UNIVERSE = _universe_sql(NOW)
_PASSED = "passed AS (SELECT ticker, arg_min(reason, group_no) AS reason FROM (" + " UNION ALL ".join(
    f"SELECT * FROM g{i}_r" for i in range(4)
) + ") GROUP BY 1)"
_RANKS = " UNION ALL ".join(f"SELECT '{r}' AS reason, {i} AS rank" for i, r in enumerate(U.REASONS))
_TR = f"WITH {FEED_SQL}, {TRADES_SQL}"
_LT = """lt AS (SELECT concat('P', l_partkey % 50, '-T', l_partkey) AS ticker, concat('P', l_partkey % 50) AS series_ticker,
  concat(l_orderkey, '/', l_linenumber, '/', l_suppkey) AS trade_id, CAST(epoch_ms(l_shipdate) AS BIGINT) AS ts_ms, l_orderkey AS seq,
  (l_orderkey * 13 + l_linenumber * 700) % 9900 + 50 AS price_e4, CAST(l_quantity * 100 AS BIGINT) AS count_e2, l_linenumber % 2 AS taker_side FROM lineitem)"""
_CAT = f"""cat AS (SELECT ticker, regexp_extract(ticker, '^([^-]*-[^-]*)', 1) AS event_ticker, split_part(ticker, '-', 1) AS series_ticker,
  volume_24h, CASE WHEN u % 9 <> 0 THEN {DAY_2024_S} + u * 3600 END AS close_ts, u % 2 = 0 AS showcase FROM (
  SELECT ticker, CAST(sum(size_e2) AS BIGINT) AS volume_24h, max(user_id) AS u FROM feed GROUP BY 1))"""
_LIFE = f"""life AS (SELECT ticker, bool_or(event_id % 211 = 0) AS ended,
  arg_max({DAY_2024_S} + (event_id % 1000) * 3600, recv_wall_ns) FILTER (event_id % 211 <> 0 AND event_id % 7 = 0 AND event_id % 14 <> 0) AS moved_close_ts
  FROM feed WHERE event_type = 'click' GROUP BY 1)"""
_QUOTES = "quotes AS (SELECT ticker, arg_max(price_e4, recv_mono_ns) AS last_e4 FROM trades GROUP BY 1)"
_STALE = """known AS (SELECT DISTINCT ticker FROM feed WHERE kind IN ('S','D')), lasts AS (SELECT ticker, max(recv_mono_ns) AS t, any_value(conn_id) AS c FROM feed WHERE kind = 'S' GROUP BY 1)"""

from bookstrata.plans.book_queries import _FULL  # noqa: E402

_MROWS = f"""{_FULL}, {TRADES_SQL}, {_CAT}, {_LIFE}, {_QUOTES}, mrows AS (
  SELECT c.ticker, c.event_ticker, c.series_ticker, concat('Title ', c.event_ticker) AS title, CASE WHEN c.showcase THEN 'Sports' END AS category,
    c.showcase, c.volume_24h AS volume_24h_e2, coalesce(l.moved_close_ts, c.close_ts) AS close_ts, q.last_e4 - 100 AS bid_e4,
    q.last_e4 + 100 AS ask_e4, q.last_e4, CASE WHEN e.ticker IS NULL THEN 'unknown' WHEN e.stale THEN 'stale' ELSE 'fresh' END AS book,
    coalesce(l.ended, FALSE) AS ended, e.ts AS depth_ts_ms
  FROM cat c LEFT JOIN life l USING (ticker) LEFT JOIN quotes q USING (ticker) LEFT JOIN f_end e USING (ticker))"""
_NOW2 = DAY_2024_S + 40 * 3600

ORACLE = {
    "universe_chosen": f"""{_UNIVERSE} SELECT "group", ticker, pos, CAST(place AS INTEGER) AS place, place <= {POLICY.max_markets} AS admitted, showcase FROM chosen""",
    "universe_reasons": f"""{_UNIVERSE}, {_PASSED}, r AS (SELECT {_why(NOW)} AS reason, 1 AS n FROM dd WHERE {_why(NOW)} IS NOT NULL
      UNION ALL SELECT coalesce(passed.reason, 'no_group'), 1 FROM ok LEFT JOIN passed USING (ticker) WHERE ticker NOT IN (SELECT ticker FROM chosen)
      UNION ALL SELECT 'over_cap', 1 FROM chosen WHERE place > {POLICY.max_markets}
      UNION ALL SELECT 'duplicate', extra FROM dd)
      SELECT k.reason, k.rank, coalesce(CAST(sum(n) AS BIGINT), 0) AS markets FROM ({_RANKS}) k LEFT JOIN r USING (reason) GROUP BY 1, 2""",
    "universe_groups": f"""{_UNIVERSE} SELECT "group", group_no, count(*) FILTER (place <= {POLICY.max_markets}) AS admitted,
      count(DISTINCT concat(series_ticker, '|', event_ticker)) FILTER (place <= {POLICY.max_markets}) AS events,
      count(*) FILTER (place > {POLICY.max_markets}) AS skipped_for_budget FROM chosen GROUP BY 1, 2""",
    "universe_pinned": f"""{_universe_sql(NOW + 3600, '''SELECT ticker, count(*) OVER () - row_number() OVER (ORDER BY ticker) AS pos FROM (
      SELECT DISTINCT ticker FROM listing WHERE series_ticker = 'BRAND23' ORDER BY ticker LIMIT 9)''')}
      SELECT "group", ticker, pos, CAST(place AS INTEGER) AS place FROM chosen""",
    "listing_deduped": f"WITH {_DEDUPED} SELECT ticker, volume_24h, extra FROM dd",
    "eligibility": f"WITH {_DEDUPED} SELECT coalesce({_why(NOW)}, '-') AS reason, count(*) AS markets FROM dd GROUP BY 1",
    "event_totals": f"""WITH {_DEDUPED} SELECT series_ticker, event_ticker, CAST(sum(volume_24h) AS BIGINT) AS event_volume, min(close_ts) AS event_close,
      count(*) = count(*) FILTER (strike_type LIKE 'greater%' OR strike_type LIKE 'less%') AS all_thresholds FROM dd GROUP BY 1, 2""",
    "category_coverage": f"WITH {LISTING_SQL}, {_CATS} SELECT k.c AS category, count(cats.category) AS series FROM (VALUES ('even'), ('odd'), ('misspelled')) k(c) LEFT JOIN cats ON cats.category = k.c GROUP BY 1",
    "absent_series": f"WITH {LISTING_SQL} SELECT s AS series_ticker FROM (VALUES ('BRAND11'), ('BRAND12'), ('BRAND23'), ('BRAND7'), ('NOSUCH')) v(s) WHERE s NOT IN (SELECT series_ticker FROM listing)",
    "membership_changes": f"""WITH {_DEDUPED}, n AS (SELECT ticker, series_ticker AS s, CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) AS n FROM dd),
      cur AS (SELECT s AS "group", ticker FROM n WHERE n % 5 <> 0), des AS (SELECT CASE WHEN n % 7 = 0 THEN 'moved' ELSE s END AS "group", ticker FROM n WHERE n % 6 <> 0)
      SELECT *, 'added' AS change FROM (SELECT * FROM des EXCEPT SELECT * FROM cur) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM cur EXCEPT SELECT * FROM des)""",
    "audit_rotation": f"""WITH {FEED_SQL}, r AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT ticker FROM feed)),
      s AS (SELECT *, 1130 % total AS start, least(70, total) AS take FROM r)
      SELECT ticker, (i - start + total) % total AS nth, (start + take) % total AS next_cursor FROM s WHERE (i - start + total) % total < take""",
    "unpriced_events": f"""{_UNIVERSE} SELECT "group", c.event_ticker, count(*) AS unpriced FROM chosen c JOIN dd USING (ticker)
      WHERE place <= {POLICY.max_markets} AND "group" = 'near' AND {_MID.replace('yes_', 'dd.yes_').replace('last_price', 'dd.last_price')} IS NULL GROUP BY 1, 2""",
    "converted_listing": f"""WITH {LISTING_SQL}, n AS (SELECT *, CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) AS n FROM listing)
      SELECT ticker, series_ticker, CASE WHEN n % 19 <> 0 THEN volume_24h END AS volume_24h, CASE WHEN n % 23 <> 0 THEN close_ts END AS close_ts,
        yes_bid, yes_ask, last_price, n % 19 = 0 OR n % 23 = 0 AS bad FROM n""",
    "listing_report": f"""WITH {LISTING_SQL}, n AS (SELECT CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) AS n FROM listing)
      SELECT count(*) FILTER (n % 19 <> 0 AND n % 23 <> 0) AS markets, count(*) FILTER (n % 19 = 0 OR n % 23 = 0) AS unreadable FROM n""",
    "series_categories": f"WITH {LISTING_SQL}, {_CATS} SELECT series_ticker, category FROM cats WHERE category = 'even'",
    "latest_tickers": f"{_TR}, {_QUOTES} SELECT ticker, last_e4 - 100 AS bid_e4, last_e4 + 100 AS ask_e4, last_e4 FROM quotes",
    "lifecycle_state": f"WITH {FEED_SQL}, {_LIFE} SELECT * FROM life",
    "open_catalog": f"WITH {FEED_SQL}, {_CAT}, {_LIFE} SELECT ticker, coalesce(moved_close_ts, close_ts) AS close_ts FROM cat LEFT JOIN life USING (ticker) WHERE NOT coalesce(ended, FALSE)",
    "market_rows": f"{_MROWS} SELECT * EXCLUDE (depth_ts_ms) FROM mrows",
    "market_details": f"""{_MROWS}, lv AS (SELECT ticker, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS a, max(price_e4) FILTER (side = 0) AS t FROM f_lv GROUP BY 1)
      SELECT ticker, book, depth_ts_ms, CASE WHEN lv.ticker IS NULL THEN NULL ELSE least(20, b) END AS bids, CASE WHEN lv.ticker IS NULL THEN NULL ELSE least(20, a) END AS asks, t AS top_bid
      FROM mrows LEFT JOIN lv USING (ticker)""",
    "top_markets": f"{_MROWS} SELECT ticker, volume_24h_e2, close_ts FROM mrows WHERE NOT ended AND (close_ts IS NULL OR close_ts > {_NOW2}) ORDER BY volume_24h_e2 DESC, ticker LIMIT 50",
    "market_search": f"{_MROWS} SELECT ticker FROM mrows WHERE category ILIKE '%sport%' OR ticker ILIKE '%e7-%' OR title ILIKE '%e7-%' OR ticker ILIKE '%sport%' OR title ILIKE '%sport%'",
    "close_clock": f"WITH {FEED_SQL}, {_CAT} SELECT max(close_ts) FILTER (close_ts <= {_NOW2}) * 1000 AS last_ms, (min(close_ts) FILTER (close_ts > {_NOW2}) - {_NOW2}) * 1000 AS next_in_ms FROM cat",
    "recorder_health": f"WITH {FEED_SQL} SELECT event_id AS universe_size, 2592000000000000 - recv_mono_ns <= 40000000000 AS recording, (2592000000000000 - recv_mono_ns) // 1000000 AS age_ms FROM feed ORDER BY recv_mono_ns DESC LIMIT 1",
    "subscription_checks": f"""WITH {FEED_SQL}, {_CAT}, once AS (SELECT conn_id AS session, ticker, min(event_id) AS pos FROM feed GROUP BY 1, 2),
      k AS (SELECT once.*, cat.ticker IS NOT NULL AS known FROM once LEFT JOIN cat ON cat.ticker = once.ticker AND cat.showcase)
      SELECT session, ticker, pos, CASE WHEN NOT known THEN 'unknown_ticker' WHEN (SELECT count(*) FROM k o WHERE o.session = k.session AND o.known AND o.pos <= k.pos) > 10
        THEN 'too_many_tickers' END AS rejected FROM k""",
    "topics": f"WITH {FEED_SQL} SELECT CASE WHEN kind = 'G' THEN 'ctl.gap' WHEN event_type = 'click' THEN 'ctl.lifecycle' ELSE concat('md.', ticker) END AS topic, count(*) AS messages FROM feed GROUP BY 1",
    "trade_candles": f"""WITH {_LT} SELECT DISTINCT ticker, ts_ms - ts_ms % 86400000 AS start_ms, first_value(price_e4) OVER w AS open_e4, max(price_e4) OVER w AS high_e4,
      min(price_e4) OVER w AS low_e4, last_value(price_e4) OVER w AS close_e4, CAST(sum(count_e2) OVER w AS BIGINT) AS volume_e2, count(*) OVER w AS trades FROM lt
      WINDOW w AS (PARTITION BY ticker, ts_ms - ts_ms % 86400000 ORDER BY ts_ms, seq, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "candle_agreement": f"""{_TR}, c AS (SELECT ticker, ts_ms // 60000 AS m, CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) AS n FROM trades GROUP BY ALL)
      SELECT count(*) FILTER (n % 10 <> 0 AND n % 11 <> 0) AS agreeing, count(*) AS candles, count(*) FILTER (n % 10 = 0) AS only_ours, 0 AS only_listed FROM c""",
    "trade_fees": f"""WITH {_LT}, r AS (SELECT *, CASE WHEN ts_ms >= 1704067200000 THEN 50 WHEN ts_ms >= epoch_ms(DATE '1995-06-01') THEN 35 ELSE 70 END AS rate FROM lt)
      SELECT series_ticker, count(*) AS trades, CAST(sum((CAST(rate AS HUGEINT) * count_e2 * price_e4 * (10000 - price_e4) + 99999999999) // 100000000000 * 10000) AS BIGINT) AS fee_e6 FROM r GROUP BY 1""",
    "maker_fees": f"""WITH {_LT}, r AS (SELECT *, CASE CAST(regexp_extract(series_ticker, '([0-9]+)$', 1) AS INTEGER) % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS q FROM lt)
      SELECT series_ticker, count(*) AS trades, CAST(sum((CAST(7 * q AS HUGEINT) * count_e2 * price_e4 * (10000 - price_e4) + 39999999999) // 40000000000 * 10000) AS BIGINT) AS fee_e6 FROM r GROUP BY 1""",
    "rebuilt_groups": f"""WITH {_DEDUPED}, n AS (SELECT ticker, series_ticker AS g, CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) AS n,
        CAST(regexp_extract(series_ticker, '([0-9]+)$', 1) AS INTEGER) AS s FROM dd),
      cur AS (SELECT g, ticker, s FROM n WHERE n % 2 = 0),
      des AS (SELECT g, ticker, s FROM n WHERE n % 2 = CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END OR (n % 9 = 0 AND s % 5 <> 0)),
      p AS (SELECT g, any_value(s) % 4 = 0 AS moved, count(DISTINCT ticker) FILTER (ticker IN (SELECT ticker FROM cur)) = 0 AS replaced
        FROM des WHERE g IN (SELECT g FROM cur) GROUP BY g)
      SELECT g AS "group", CASE WHEN moved AND replaced THEN 'moved and replaced' WHEN moved THEN 'moved' ELSE 'replaced' END AS why FROM p WHERE moved OR replaced""",
    "requested_series": f"""WITH {LISTING_SQL}, n AS (SELECT ticker, series_ticker, CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) AS n FROM listing)
      SELECT ticker, series_ticker FROM n WHERE series_ticker IN ('BRAND11', 'BRAND23') AND (n % 3 <> 0 OR series_ticker = 'BRAND11')""",
    "trade_reconciliation": f"""{_TR} SELECT state, count(*) AS trades FROM (SELECT CASE WHEN seq % 7 = 0 AND seq % 10 = 0 THEN NULL WHEN seq % 10 = 0 THEN 'only_recorded'
      WHEN seq % 7 = 0 THEN 'only_listed' WHEN seq % 33 = 0 THEN 'different' ELSE 'equal' END AS state FROM trades) WHERE state IS NOT NULL GROUP BY 1""",
    "whole_slice": f"{_TR} SELECT recv_wall_ns, trade_id, FALSE AS truncated FROM trades",
    "capped_trades": f"{_TR} SELECT recv_wall_ns, trade_id, (SELECT count(*) > 100 FROM trades) AS truncated FROM trades ORDER BY recv_wall_ns LIMIT 100",
    "profit_and_loss": f"""WITH {_LT}, s AS (SELECT *, CASE WHEN taker_side = 0 THEN 1 ELSE -1 END AS sg FROM lt)
      SELECT ticker, CAST(sum(sg * count_e2) AS BIGINT) AS position_e2, CAST(sum(sg * count_e2 * price_e4) AS BIGINT) AS cost_e6, CAST(sum(count_e2 * 7) AS BIGINT) AS fees_e6,
        CAST(CASE WHEN max(price_e4) > 9000 THEN sum(sg * count_e2) * 10000 ELSE 0 END - sum(sg * count_e2 * price_e4) - sum(count_e2 * 7) AS BIGINT) AS pnl_e6 FROM s GROUP BY 1""",
    "markouts": f"""{_TR}, m AS (SELECT a.ticker, a.taker_side, a.price_e4, (SELECT arg_min(b.price_e4, b.recv_mono_ns) FROM trades b
      WHERE b.ticker = a.ticker AND b.recv_mono_ns >= a.recv_mono_ns + 86400000000000) AS later FROM trades a)
      SELECT ticker, CAST(sum(CASE WHEN taker_side = 0 THEN later - price_e4 ELSE price_e4 - later END) AS BIGINT) AS markout_e4, count(later) AS measured FROM m GROUP BY 1""",
    "volume_buckets": f"""WITH {_LT}, c AS (SELECT *, coalesce(sum(count_e2) OVER (PARTITION BY ticker ORDER BY ts_ms, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM lt)
      SELECT ticker, CAST(done // 50000 AS BIGINT) AS bucket, CAST(sum(CASE WHEN taker_side = 0 THEN count_e2 ELSE 0 END) AS BIGINT) AS bought_e2,
        CAST(sum(CASE WHEN taker_side = 1 THEN count_e2 ELSE 0 END) AS BIGINT) AS sold_e2 FROM c GROUP BY 1, 2""",
    "green_months": """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(*) FILTER (event_type <> 'error') AS g, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)
      SELECT dt[1:7] AS month, count(*) AS days, count(*) FILTER (g * 100 >= n * 79 AND c * 100 <= n * 21) AS green_days FROM d GROUP BY 1""",
}
