"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookstrata.functions import clock as C
from bookstrata.functions import display as D
from bookstrata.functions import exact as E
from bookstrata.functions import grid as G
from bookstrata.functions import levels as L
from bookstrata.functions import markets as K
from bookstrata.functions.register import register
from bookstrata.sources import sample
from bookstrata.sources.sample import FEED_SQL, LISTING_SQL


# A double's exact value decides, and one that is half-way itself goes up.
_HALF = "((volume_24h % 10) * 1000 + (volume_24h // 10 % 10) * 100 + 50)"
_HALF_WAY = (
    f"CASE WHEN {_HALF} < 1000 THEN CAST({_HALF} AS VARCHAR) WHEN {_HALF} % 1000 = 250 THEN concat({_HALF} // 1000, '.3K') "
    f"ELSE concat(regexp_replace(printf('%.1f', {_HALF} / 1000.0), '\\.0$', ''), 'K') END"
)


def _texts(spark, sf):
    """Number texts of many shapes, one per order key remainder."""
    key = F.col("l_orderkey")
    n = F.pmod(key * 7, F.lit(12_000))
    digits = F.lpad((n % 10_000).cast("string"), 4, "0")
    whole = F.expr("pmod(l_orderkey * 7, 12000) div 10000").cast("string")
    plain = F.concat(whole, F.lit("."), digits)
    text = (
        F.when(key % 8 == 0, F.concat(plain, F.lit("00")))
        .when(key % 8 == 1, F.concat(plain, F.lit("5")))
        .when(key % 8 == 2, F.concat(F.lit("-"), plain))
        .when(key % 8 == 3, F.substring(plain, 1, 4))
        .when(key % 8 == 4, whole)
        .when(key % 8 == 5, F.concat(plain, F.lit("x")))
        .otherwise(plain)
    )
    return sample.table(spark, sf, "lineitem").select(text.alias("text")).distinct()


def parse_numbers(spark, sf):
    t = _texts(spark, sf)
    return t.select(
        "text", E.parse_price("text").alias("price_e4"), E.parse_count("text").alias("count_e2"),
        E.parse_signed_count("text").alias("signed_e2"), E.parse_dollars("text").alias("dollars_e6"),
    )


def format_numbers(spark, sf):
    d = sample.deltas(spark, sf)
    return d.select(
        "seq", E.format_price("price_e4").alias("price"), E.format_count("delta_e2").alias("delta"),
        E.format_dollars(E.notional_e6("price_e4", "delta_e2")).alias("notional"),
        E.format_price(E.complement("price_e4")).alias("other_leg"),
    )


def exact_division(spark, sf):
    rows = sample.table(spark, sf, "lineitem")
    a = (F.col("l_orderkey") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).cast("bigint")
    b = ((F.col("l_suppkey") % 9 + 1) * F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1)).cast("bigint")
    pairs = rows.select(a.alias("a"), b.alias("b")).distinct()
    return pairs.select("a", "b", E.div_floor("a", "b").alias("floor"), E.div_ceil("a", "b").alias("ceil"))


def time_keys(spark, sf):
    f = sample.feed(spark, sf)
    return f.select(
        "event_id", C.hour_label("recv_wall_ns").alias("label"), C.hour_start("recv_wall_ns").alias("hour_start"),
        C.hour_end("recv_wall_ns").alias("hour_end"), C.ns_to_ms(F.col("recv_wall_ns") - 1_710_000_000_000_000_001).alias("ms"),
        C.keyframe_slot("recv_wall_ns", 300).alias("slot"), C.parse_hour_label(C.hour_label("recv_wall_ns")).alias("parsed"),
    )


def closed_hours(spark, sf):
    """Hours of the feed closed by the middle of the month, with two minutes of grace."""
    hours = sample.feed(spark, sf).select(C.hour_start("recv_wall_ns").alias("start_ns")).distinct()
    return hours.where(C.is_closed_hour("start_ns", 1_705_276_800_000_000_000, 120 * C.NS_PER_S))


def name_checks(spark, sf):
    """Segment and ticker names, half of them of the wrong shape."""
    f = sample.feed(spark, sf)
    label = C.hour_label("recv_wall_ns")
    name = F.concat(
        F.substring(label, 1, 10), F.when(F.col("event_id") % 2 == 0, "/").otherwise("_"), F.substring(label, 12, 2),
        F.lit("/conn-"), F.col("conn_id").cast("string"), F.lit(".zst"),
    )
    ticker = F.when(F.col("event_id") % 3 == 0, F.lower("ticker")).otherwise(F.col("ticker"))
    return f.select("event_id", C.segment_hour(name).alias("hour"), C.is_ticker(ticker).alias("ticker_ok"))


def listing_prices(spark, sf):
    m = sample.listing(spark, sf)
    return m.select(
        "ticker", "volume_24h", K.series_of("ticker").alias("series"),
        K.yes_mid("yes_bid", "yes_ask", "last_price").alias("mid"),
    )


def close_times(spark, sf):
    """Close-time text of several shapes to Unix seconds."""
    o = sample.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey")
    text = (
        F.when(key % 5 == 0, "").when(key % 5 == 1, "0001-01-01T00:00:00Z")
        .when(key % 5 == 2, F.concat(day, F.lit("T12:34:56Z")))
        .when(key % 5 == 3, F.concat(day, F.lit("T12:34:56+02:00")))
        .otherwise(F.concat(day, F.lit("T12:34:56")))
    )
    return o.select("o_orderkey", K.parse_close_ts(text).alias("close_ts"))


def price_grids(spark, sf):
    """Grid of each part's made-up price ranges."""
    # A few bytes of a part become up to 9,999 prices, so rows are dealt out before that: a scan task may hold millions.
    p = sample.table(spark, sf, "part").select("p_partkey").repartition("p_partkey")
    step = F.element_at(F.array(*[F.lit(s) for s in (100, 10, 1, 50, 30)]), (F.col("p_partkey") % 5 + 1).cast("int"))
    one = F.array(F.struct(F.lit(0).alias("start_e4"), F.lit(10_000).alias("end_e4"), step.alias("step_e4")))
    ranges = F.when(F.col("p_partkey") % 7 != 0, one)
    grid = G.price_grid(ranges)
    price = ((F.col("p_partkey") * 37) % 10_001).cast("int")
    rows = p.select("p_partkey", ranges.alias("ranges"), grid.alias("g"), price.alias("price"))
    row = G.row_for_price("price", F.col("g.row_step_e4"), F.col("g.rows"))
    return rows.select(
        "p_partkey", "g.tick_e4", "g.row_step_e4", "g.rows", "g.assumed", row.alias("row"),
        G.price_for_row(row, F.col("g.row_step_e4")).alias("row_price"), G.cent_decimals("g.tick_e4").alias("decimals"),
        F.coalesce(F.size(G.grid_prices("ranges")), F.lit(0)).alias("ticks"),
    )


def display_scales(spark, sf):
    t = sample.trades(spark, sf)
    contracts = F.col("count_e2") / 100
    return t.select(
        "trade_id", F.round(G.depth_value(contracts), 6).alias("depth"), G.depth_ceiling(contracts * 10).alias("ceiling"),
        F.round(G.depth_ramp_position(contracts, G.depth_ceiling(contracts * 10)), 6).alias("position"),
        F.size(G.depth_legend_ticks(G.depth_ceiling(contracts * 10))).alias("ticks"),
        G.bubble_reference(contracts * 50).alias("reference"),
        F.round(G.bubble_radius_px(contracts, G.bubble_reference(contracts * 50)), 6).alias("radius"),
        G.bin_index(F.col("ts_ms"), F.lit(1_704_067_200_000)).alias("bin"),
        G.ring_column(G.bin_index(F.col("ts_ms"), F.lit(1_704_067_200_000))).alias("slot"),
    )


def display_labels(spark, sf):
    m = sample.listing(spark, sf)
    now_ms = 1_704_067_200_000
    # Half-way between two tenths: 50, 150, ... contracts past every thousand below 10,000.
    half_way = (F.col("volume_24h") % 10) * 1_000 + (E.floor_div("volume_24h", 10) % 10) * 100 + 50
    return m.select(
        "ticker", "volume_24h", D.format_cents("yes_bid").alias("bid"), D.format_contracts("volume_24h").alias("volume"),
        D.format_compact_contracts("volume_24h").alias("compact"),
        D.format_compact_contracts(half_way * 100).alias("half_way"), D.format_closes("close_ts", now_ms).alias("closes"),
        D.format_ago(F.col("volume_24h")).alias("ago"), D.market_label("ticker", F.col("strike_type"), F.lit(None).cast("string"))["primary"].alias("label"),
    )


def sql_functions(spark, sf):
    """The functions published for SQL."""
    register(spark)
    sample.deltas(spark, sf).createOrReplaceTempView("deltas_for_sql")
    return spark.sql(
        "SELECT seq, parse_price_e4(format_price_e4(price_e4)) AS price_e4, format_count_e2(delta_e2) AS delta, "
        "complement_e4(price_e4) AS other_leg, notional_e6(price_e4, delta_e2) AS notional, series_of(ticker) AS series, "
        "hour_label(recv_wall_ns) AS hour FROM deltas_for_sql"
    )


def level_hashes(spark, sf):
    s = sample.snapshots(spark, sf)
    return s.select("seq", "side", "price_e4", L.unsigned(L.level_mix64("side", "price_e4", "count_e2")).cast("string").alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_numbers, format_numbers, exact_division, time_keys, closed_hours, name_checks,
        listing_prices, close_times, price_grids, display_scales, display_labels, sql_functions,
        level_hashes,
    )
}

_FMT = "concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, abs({x}) // {s}, '.', lpad(CAST(abs({x}) % {s} AS VARCHAR), {d}, '0'))"


def _fmt(x: str, d: int) -> str:
    return _FMT.format(x=x, s=10**d, d=d)


_H = 3_600_000_000_000
_LABEL = f"strftime(make_timestamp(recv_wall_ns // 1000), '%Y-%m-%dT%H')"
_NUM = "CASE WHEN regexp_full_match(text, '-?[0-9]+(\\.[0-9]{{1,{d}}}0*)?') THEN CAST(CAST(text AS DECIMAL(38,10)) * {s} AS BIGINT) END"
_MIX_ONE = """m1 AS (SELECT event_id AS seq, lv_side AS side, lv_price AS price_e4, (CAST(lv_side AS UHUGEINT) << 63)
    + (CAST(lv_price AS UHUGEINT) << 44) + CAST(lv_count AS UHUGEINT) AS z FROM snaps),
m2 AS (SELECT * REPLACE ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM m1),
m3 AS (SELECT * REPLACE ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM m2)"""

ORACLE = {
    "parse_numbers": f"""WITH n AS (SELECT l_orderkey AS k, (l_orderkey * 7) % 12000 AS n FROM lineitem),
      p AS (SELECT k, concat(n // 10000, '.', lpad(CAST(n % 10000 AS VARCHAR), 4, '0')) AS plain, CAST(n // 10000 AS VARCHAR) AS whole FROM n),
      t AS (SELECT DISTINCT CASE k % 8 WHEN 0 THEN plain || '00' WHEN 1 THEN plain || '5' WHEN 2 THEN '-' || plain
        WHEN 3 THEN plain[1:4] WHEN 4 THEN whole WHEN 5 THEN plain || 'x' ELSE plain END AS text FROM p),
      v AS (SELECT text, {_NUM.format(d=4, s=10000)} AS p, {_NUM.format(d=2, s=100)} AS c, {_NUM.format(d=6, s=1000000)} AS d FROM t)
      SELECT text, CASE WHEN p BETWEEN 0 AND 10000 THEN p END AS price_e4, CASE WHEN c >= 0 THEN c END AS count_e2,
        c AS signed_e2, d AS dollars_e6 FROM v""",
    "format_numbers": f"""WITH {FEED_SQL} SELECT event_id AS seq, {_fmt('price_e4', 4)} AS price, {_fmt('delta_e2', 2)} AS delta,
      {_fmt('(price_e4 * delta_e2)', 6)} AS notional, {_fmt('(10000 - price_e4)', 4)} AS other_leg FROM feed WHERE kind = 'D'""",
    "exact_division": """WITH p AS (SELECT DISTINCT l_orderkey * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS a,
        (l_suppkey % 9 + 1) * CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS b FROM lineitem)
      SELECT a, b, CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) AS floor, CAST(ceil(CAST(a AS DOUBLE) / b) AS BIGINT) AS ceil FROM p""",
    "time_keys": f"""WITH {FEED_SQL} SELECT event_id, {_LABEL} AS label, recv_wall_ns - recv_wall_ns % {_H} AS hour_start,
      recv_wall_ns - recv_wall_ns % {_H} + {_H} AS hour_end,
      CAST(floor(CAST(recv_wall_ns - 1710000000000000001 AS DECIMAL(38,6)) / 1000000) AS BIGINT) AS ms,
      recv_wall_ns - recv_wall_ns % 300000000000 AS slot, recv_wall_ns - recv_wall_ns % {_H} AS parsed FROM feed""",
    "closed_hours": f"""WITH {FEED_SQL} SELECT DISTINCT recv_wall_ns - recv_wall_ns % {_H} AS start_ns FROM feed
      WHERE recv_wall_ns - recv_wall_ns % {_H} + {_H} + 120000000000 < 1705276800000000000""",
    "name_checks": f"""WITH {FEED_SQL} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_LABEL} END AS hour, event_id % 3 <> 0 AS ticker_ok FROM feed""",
    "listing_prices": f"""WITH {LISTING_SQL} SELECT ticker, volume_24h, series_ticker AS series,
      CASE WHEN yes_bid IS NOT NULL AND yes_ask IS NOT NULL THEN (yes_bid + yes_ask) // 2 ELSE last_price END AS mid FROM listing""",
    "close_times": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= 2 THEN CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) + 45296
      - CASE WHEN o_orderkey % 5 = 3 THEN 7200 ELSE 0 END END AS close_ts FROM orders""",
    "price_grids": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN ([100, 10, 1, 50, 30])[p_partkey % 5 + 1] END AS step,
        (p_partkey * 37) % 10001 AS price FROM part),
      g AS (SELECT *, coalesce(step, 100) AS tick, (SELECT min(s) FROM unnest([10,16,20,25,40,50,80,100,125,200,250,400,500,625,1000,1250,2000,2500,5000,10000]) u(s)
        WHERE s >= coalesce(step, 100)) AS rs FROM p)
      SELECT k AS p_partkey, tick AS tick_e4, rs AS row_step_e4, 10000 // rs + 1 AS rows, step IS NULL AS assumed,
        least(10000 // rs, CAST(floor(CAST(price AS DOUBLE) / rs + 0.5) AS BIGINT)) AS row,
        least(10000 // rs, CAST(floor(CAST(price AS DOUBLE) / rs + 0.5) AS BIGINT)) * rs AS row_price,
        CASE WHEN tick % 100 = 0 THEN 0 WHEN tick % 10 = 0 THEN 1 ELSE 2 END AS decimals,
        CASE WHEN step IS NULL THEN 0 ELSE (9999 // step) END AS ticks FROM g""",
    "display_scales": f"""WITH {FEED_SQL}, t AS (SELECT concat('t', event_id) AS trade_id, size_e2 / 100.0 AS c, ts_ms FROM feed WHERE kind = 'T'),
      s AS (SELECT *, CASE WHEN c * 10 <= 128 THEN 128.0 ELSE pow(2, ceil(log2(c * 10))) END AS ceiling,
        1024.0 * pow(4, greatest(0, ceil(log2(greatest(c * 50, 1024) / 1024.0) / 2))) AS reference,
        greatest(0, (ts_ms - 1704067200000) // 250) AS bin FROM t)
      SELECT trade_id, round(ln(1 + c), 6) AS depth, ceiling, round(least(1, ln(1 + c) / ln(1 + ceiling)), 6) AS position,
        CAST(floor(log10(ceiling)) AS INTEGER) + 1 AS ticks, reference,
        round(least(14.0, greatest(2.0, sqrt(c / reference) * 14.0)), 6) AS radius, bin, bin % 2048 AS slot FROM s""",
    "display_labels": f"""WITH {LISTING_SQL}, v AS (SELECT *, volume_24h // 100 AS c, close_ts - 1704067200 AS r, yes_bid % 100 AS fr FROM listing)
      SELECT ticker, volume_24h, CASE WHEN yes_bid IS NULL THEN '—' ELSE concat(yes_bid // 100, CASE WHEN fr = 0 THEN '' WHEN fr % 10 = 0 THEN concat('.', fr // 10)
          ELSE concat('.', lpad(CAST(fr AS VARCHAR), 2, '0')) END, '¢') END AS bid,
        format('{{:,}}', c) AS volume,
        CASE WHEN c < 1000 THEN CAST(c AS VARCHAR) WHEN c < 10000 AND c % 1000 = 250 THEN concat(c // 1000, '.3K')
          WHEN c < 10000 THEN concat(regexp_replace(printf('%.1f', c / 1000.0), '\\.0$', ''), 'K') WHEN c < 1000000 THEN concat(c // 1000, 'K')
          WHEN c >= 10000000 THEN concat(c // 1000000, 'M') WHEN c % 1000000 = 250000 THEN concat(c // 1000000, '.3M')
          ELSE concat(regexp_replace(printf('%.1f', c / 1000000.0), '\\.0$', ''), 'M') END AS compact, {_HALF_WAY} AS half_way,
        CASE WHEN close_ts IS NULL THEN NULL WHEN r <= 0 THEN 'closed' WHEN r < 3600 THEN concat('closes in ', greatest(1, r // 60), 'm')
          WHEN r < 172800 THEN concat('closes in ', r // 3600, 'h') ELSE concat('closes in ', r // 86400, 'd') END AS closes,
        CASE WHEN volume_24h // 1000 < 1 THEN 'now' WHEN volume_24h // 1000 < 60 THEN concat(volume_24h // 1000, 's')
          WHEN volume_24h // 1000 < 3600 THEN concat(volume_24h // 60000, 'm') ELSE concat(volume_24h // 3600000, 'h') END AS ago,
        coalesce(strike_type, ticker) AS label FROM v""",
    "sql_functions": f"""WITH {FEED_SQL} SELECT event_id AS seq, price_e4, {_fmt('delta_e2', 2)} AS delta, 10000 - price_e4 AS other_leg,
      price_e4 * delta_e2 AS notional, split_part(ticker, '-', 1) AS series, {_LABEL} AS hour FROM feed WHERE kind = 'D'""",
    "level_hashes": f"""WITH {FEED_SQL}, {sample.SNAPSHOTS_SQL}, {_MIX_ONE} SELECT seq, side, price_e4, CAST(xor(z, z >> 31) AS VARCHAR) AS hash FROM m3""",
}
