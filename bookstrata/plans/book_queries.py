"""Book reconstruction and views of books, over the sample feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_DAY, RESTART_DROP_NS
from bookstrata.operators import books as B
from bookstrata.operators import heatmap as H
from bookstrata.operators import metrics as M
from bookstrata.operators import replay as R
from bookstrata.operators.directory import quote_fallback
from bookstrata.operators.ordering import restart_boundaries, restarts, with_stretch
from bookstrata.plans import shared
from bookstrata.sources import sample
from bookstrata.sources.sample import EPOCH_2024_NS, FEED_SQL, TRADES_SQL

QUARTER_DAY_MS = 21_600_000
BINS = 120


def books_at(spark, sf):
    """Levels of every book at the end of the feed."""
    return shared.whole_replay(spark, sf).levels


def book_status(spark, sf):
    return shared.final_books(spark, sf).status.select("ticker", "stale", "last_ts_ms")


SMALL_SLICES = 16
_APART_NS = 3_600_000_000_000
# A month of the sample becomes less than a minute.
_SQUEEZE = 45_000


def books_at_sliced(spark, sf):
    """As ``books_at``, with slices so small that levels are carried from slice to slice."""
    return shared.whole_replay(spark, sf, SMALL_SLICES).levels


def book_status_sliced(spark, sf):
    return shared.whole_replay(spark, sf, SMALL_SLICES).status.select("ticker", "stale", "last_ts_ms")


def top_of_book(spark, sf):
    return B.book_summary(shared.final_books(spark, sf))


def book_depth(spark, sf):
    return B.depth(shared.final_books(spark, sf).levels, 5)


def book_images(spark, sf):
    images = B.book_images(shared.final_books(spark, sf).levels, B.API_DEPTH)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.concat(v["price_e4"].cast("string"), F.lit(":"), v["count_e2"].cast("string"))), ",")
    return images.select("ticker", text("bids").alias("bids"), text("asks").alias("asks"))


def book_ladder(spark, sf):
    rows = B.ladder(shared.final_books(spark, sf).levels)
    return rows.withColumn("bar_pct", F.round("bar_pct", 6))


def level_sizes(spark, sf):
    """Size at the price of every delta of the feed."""
    asked = sample.deltas(spark, sf).select("ticker", "side", "price_e4").distinct()
    return B.size_at(shared.final_books(spark, sf).levels, asked)


def book_checksums(spark, sf):
    sums = B.book_checksums(shared.final_books(spark, sf).levels)
    return sums.select("ticker", F.col("checksum").cast("string").alias("checksum"))


def book_diff(spark, sf):
    return B.diff_books(shared.middle_books(spark, sf).levels, shared.final_books(spark, sf).levels)


def book_diff_summary(spark, sf):
    return B.diff_summary(book_diff(spark, sf))


def keyframe_rows(spark, sf):
    return B.to_keyframe(shared.middle_books(spark, sf), shared.MIDDLE_NS)


def replay_from_keyframe(spark, sf):
    """The end of the feed rebuilt from a keyframe taken in its middle."""
    base = keyframe_rows(spark, sf)
    parts = [
        t.where(F.col("recv_wall_ns") > shared.MIDDLE_NS)
        for t in (sample.deltas(spark, sf), sample.snapshots(spark, sf), sample.gaps(spark, sf))
    ]
    return B.book_summary(R.replay(*parts, keyframe=base))


def keyframe_agreement(spark, sf):
    """Books rebuilt at the middle instant from an earlier keyframe, against the keyframe stored for it."""
    wall = F.col("recv_wall_ns")
    tables = sample.deltas(spark, sf), sample.snapshots(spark, sf), sample.gaps(spark, sf)
    early = B.to_keyframe(R.replay(*[t.where(wall <= shared.QUARTER_NS) for t in tables]), shared.QUARTER_NS)
    parts = [t.where((wall > shared.QUARTER_NS) & (wall <= shared.MIDDLE_NS)) for t in tables]
    return B.keyframe_agreement(R.replay(*parts, keyframe=early), keyframe_rows(spark, sf))


def time_to_fill(spark, sf):
    """How long each added quantity of the calm feed waits at the head of its level's queue."""
    added = shared.calm_timeline(spark, sf).changes().where((F.col("src") == 0) & (F.col("delta_e2") > 0))
    orders = added.select("ticker", "side", "price_e4", F.col("pos.mono").alias("placed_ns"), F.col("delta_e2").alias("ahead_e2"))
    return M.time_to_fill(orders, sample.trades(spark, sf)).select("ticker", "side", "price_e4", "placed_ns", "ahead_e2", "wait_ns")


def snapshot_images(spark, sf):
    rows = R.snapshot_images(sample.snapshots(spark, sf))
    return rows.select("ticker", "seq", F.size("levels").alias("levels"), "valid")


def host_restarts(spark, sf):
    """Rows per host boot when the monotonic clock restarts every five days."""
    rows = sample.feed(spark, sf).select(
        F.col("recv_wall_ns").alias("wall"),
        F.pmod("recv_mono_ns", F.lit(5 * NS_PER_DAY)).alias("mono"),
        F.lit(0).alias("src"),
    )
    return with_stretch(rows, restart_boundaries(rows)).groupBy("stretch").agg(
        F.count(F.lit(1)).alias("rows"), F.min("wall").alias("first_wall")
    )


def host_restarts_interleaved(spark, sf):
    """Restarts found where two clocks, an hour apart, interleave all the time."""
    apart = F.when(F.col("conn_id") % 2 == 1, F.lit(_APART_NS)).otherwise(0)
    rows = sample.feed(spark, sf).select(F.col("recv_wall_ns").alias("wall"), (F.col("recv_mono_ns") + apart).alias("mono"), F.lit(0).alias("src"))
    return restarts(rows).select("wall", "mono")


def books_at_hot_minute(spark, sf):
    """As ``books_at``, with the whole feed received within one minute and slices of sixteen changes."""
    mono = F.expr(f"recv_mono_ns div {_SQUEEZE}")
    parts = sample.deltas(spark, sf), sample.snapshots(spark, sf), sample.gaps(spark, sf)
    parts = [t.withColumns({"recv_mono_ns": mono, "recv_wall_ns": mono + EPOCH_2024_NS}) for t in parts]
    return R.replay(*parts, slice_rows=SMALL_SLICES).levels


def epoch_cuts_calm(spark, sf):
    """As ``epoch_cuts``, with so few gaps that negative levels and crossings come first in many epochs."""
    return _cut_kinds(shared.calm_timeline(spark, sf))


def top_of_book_timeline_calm(spark, sf):
    return _daily_tops(shared.calm_timeline(spark, sf).top_of_book())


def ordered_stream(spark, sf):
    """Book changes and trades as one stream, numbered per market in receive order."""
    d = sample.deltas(spark, sf).select("ticker", "recv_mono_ns", "seq")
    t = sample.trades(spark, sf).select("ticker", "recv_mono_ns", "seq")
    g = sample.gaps(spark, sf).select(F.lit(None).cast("string").alias("ticker"), "recv_mono_ns", F.col("expected_seq").alias("seq"))
    return M.ordered_stream({"delta": d, "trade": t, "gap": g}).select("stream", "ticker", "recv_mono_ns", "seq")


def merged_stream(spark, sf):
    """Changes, images, trades and gaps as one numbered stream while the clock restarts every five days."""
    images = R.snapshot_images(sample.snapshots(spark, sf))
    tables = {"delta": sample.deltas(spark, sf), "image": images, "trade": sample.trades(spark, sf), "gap": sample.gaps(spark, sf).withColumn("seq", F.col("expected_seq"))}
    clock = F.pmod("recv_mono_ns", F.lit(5 * NS_PER_DAY))
    rows = {k: t.withColumn("recv_mono_ns", clock) for k, t in tables.items()}
    kept = ("ticker", "recv_wall_ns", "recv_mono_ns", "ts_ms", "seq")
    rows = {k: t.select(*[c for c in kept if c in t.columns]) for k, t in rows.items()}
    return M.merged_stream(rows).select("position", "stream", "ticker", "stretch", "recv_mono_ns", "seq")


def epoch_cuts(spark, sf):
    """How many image epochs ended early, by what broke them."""
    return _cut_kinds(shared.timeline(spark, sf))


def _cut_kinds(line):
    starts = line.log.select("ticker", "epoch").distinct()
    return starts.join(line.cuts, ["ticker", "epoch"], "left").groupBy(
        F.coalesce("kind", F.lit("-")).alias("kind")
    ).agg(F.count(F.lit(1)).alias("epochs"))


def level_changes(spark, sf):
    """Every applied delta with its level's count after it."""
    rows = shared.timeline(spark, sf).changes().where(F.col("src") == 0)
    return rows.select("ticker", F.col("wall").alias("recv_wall_ns"), F.col("side").cast("tinyint").alias("side"), "price_e4", "delta_e2", "count_e2")


def top_of_book_timeline_sliced(spark, sf):
    return _daily_tops(shared.timeline(spark, sf, SMALL_SLICES).top_of_book())


def top_of_book_timeline(spark, sf):
    """Best prices after the last change of each market and day."""
    return _daily_tops(shared.top_timeline(spark, sf))


def _daily_tops(rows):
    day = F.expr(f"wall div {NS_PER_DAY}")
    return rows.groupBy("ticker", day.alias("day")).agg(
        F.max_by("best_bid", "pos").alias("best_bid"), F.max_by("best_ask", "pos").alias("best_ask")
    )


def impossible_trades(spark, sf):
    quoted = M.quotes_at_trades(sample.trades(spark, sf), shared.timeline(spark, sf))
    return M.impossible_trades(quoted)


def trade_quotes(spark, sf):
    quoted = M.quotes_at_trades(sample.trades(spark, sf), shared.timeline(spark, sf))
    return quoted.select("trade_id", "best_bid", "best_ask")


def heatmap_cells(spark, sf):
    shown = H.heatmap(shared.timeline(spark, sf), EPOCH_2024_NS, 0, BINS - 1, bin_ms=QUARTER_DAY_MS)
    return shown.cells.select("ticker", "bin", "row", "total_e2", F.round("depth", 6).alias("depth"))


def heatmap_columns(spark, sf):
    shown = H.heatmap(shared.timeline(spark, sf), EPOCH_2024_NS, 0, BINS - 1, bin_ms=QUARTER_DAY_MS)
    return shown.columns.select("ticker", "bin", "best_bid", "best_ask")


def heatmap_status(spark, sf):
    return H.status_bins(shared.timeline(spark, sf), EPOCH_2024_NS, 0, BINS - 1, QUARTER_DAY_MS)


def heatmap_samples(spark, sf):
    """Columns drawn for the first 140 bins when 100 are stored."""
    columns = H.heatmap(shared.timeline(spark, sf), EPOCH_2024_NS, 0, 99, bin_ms=QUARTER_DAY_MS).columns
    tickers = shared.final_books(spark, sf).status.select("ticker")
    asked = tickers.select("ticker", F.explode(F.expr("sequence(0L, 139L)")).alias("bin"))
    head = shared.final_books(spark, sf).status.select(
        "ticker", F.lit(20).cast("bigint").alias("oldest_bin"), F.lit(99).cast("bigint").alias("head_bin"),
        F.when(F.col("stale"), H.STALE).otherwise(H.FRESH).alias("edge_status"),
    )
    sampled = H.sample_bins(columns, asked, head)
    return sampled.groupBy("bin").agg(
        F.count("column").alias("drawn"), F.min("column").alias("column"),
        F.count(F.when(F.col("bin") < 20, F.when(F.col("status") == H.UNKNOWN, 1))).alias("unknown_before"),
    )


def row_totals(spark, sf):
    """Contracts per price row at the end of each bin in which the row changed."""
    return H.row_changes(shared.timeline(spark, sf), EPOCH_2024_NS, 100, 101, QUARTER_DAY_MS)


def trade_points(spark, sf):
    rows = H.trade_points(sample.trades(spark, sf), EPOCH_2024_NS)
    return rows.withColumn("bin", F.round("bin", 3))


def recent_trades(spark, sf):
    return H.recent_trades(sample.trades(spark, sf)).select("ticker", "trade_id", "nth", "price_e4", "count_e2")


def session_maxima(spark, sf):
    return H.session_maxima(sample.trades(spark, sf), row_totals(spark, sf))


def header_quotes(spark, sf):
    """Book quotes, else the last trade around which a ticker update is quoted, else the listed row."""
    books = top_of_book(spark, sf)
    last = sample.trades(spark, sf).groupBy("ticker").agg(F.max_by("price_e4", "recv_wall_ns").alias("last_e4"))
    updates = last.select("ticker", (F.col("last_e4") - 100).alias("bid_e4"), (F.col("last_e4") + 100).alias("ask_e4"), "last_e4")
    rows = sample.feed(spark, sf).select("ticker").distinct().select(
        "ticker", F.lit(1).alias("bid_e4"), F.lit(9999).alias("ask_e4"), F.lit(5000).alias("last_e4")
    )
    return quote_fallback(rows, books, updates)


def microprices(spark, sf):
    top = top_of_book(spark, sf)
    price = M.microprice_e4(F.col("best_bid"), F.col("bid_size"), F.col("best_ask"), F.col("ask_size"))
    return top.select("ticker", price.alias("microprice_e4"))


QUERIES = {
    f.__name__: f
    for f in (
        books_at, book_status, top_of_book, book_depth, book_images, book_ladder, level_sizes,
        book_checksums, book_diff, book_diff_summary, keyframe_rows, replay_from_keyframe,
        keyframe_agreement, snapshot_images, host_restarts, ordered_stream, epoch_cuts,
        level_changes, top_of_book_timeline, books_at_sliced, book_status_sliced,
        top_of_book_timeline_sliced, impossible_trades, trade_quotes, heatmap_cells,
        heatmap_columns, heatmap_status, heatmap_samples, row_totals, trade_points, recent_trades,
        session_maxima, header_quotes, microprices, host_restarts_interleaved, books_at_hot_minute,
        epoch_cuts_calm, top_of_book_timeline_calm, time_to_fill, merged_stream,
    )
}


# A market's book as a fold over its own numbered events. Levels are a map from price (bids) or
# negative price (asks) to count; ``seen`` says a change came since the fold began.
def _fold(name: str, events: str, start: str, low: str = "", high: str = "") -> str:
    return f"""
{name}_own AS (SELECT ticker, conn_id, kind, recv_mono_ns, recv_wall_ns, side, price_e4, delta_e2,
    size_e2, ts_ms FROM feed WHERE kind IN ('S','D') {low} {high}),
{name}_mkts AS ({start}),
{name}_ev AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY recv_mono_ns) AS n FROM (
    SELECT * FROM {name}_own
    UNION ALL
    SELECT m.ticker, m.conn_id, g.kind, g.recv_mono_ns, g.recv_wall_ns, 0, 0, 0, 0, NULL
    FROM {name}_mkts m JOIN feed g ON g.kind = 'G' AND g.conn_id = m.conn_id {low} {high})),
{name} AS (
  SELECT ticker, CAST(0 AS BIGINT) AS n, lv, stale, ts, FALSE AS seen, CAST(NULL AS BIGINT) AS wall,
    '-' AS why, CAST(NULL AS BIGINT) AS now_count, 0 AS images, '-' AS kind FROM {name}_mkts
  UNION ALL
  SELECT ticker, n,
    CASE WHEN kind = 'S' THEN map_from_entries(list_concat(
           list_transform(range(10), lambda k: {{'k': CAST(4000 + 100*k AS INTEGER), 'v': 100000 + size_e2}}),
           list_transform(range(10), lambda k: {{'k': CAST(-(5100 + 100*k) AS INTEGER), 'v': 100000 + size_e2}})))
         WHEN applied THEN map_concat(lv, map([key], [now_count])) ELSE lv END,
    CASE WHEN kind = 'S' THEN FALSE WHEN kind = 'G' THEN stale OR seen
         WHEN stale THEN TRUE ELSE now_count < 0 OR crossed END,
    CASE WHEN kind = 'S' THEN NULL WHEN applied AND NOT crossed THEN coalesce(ts_ms, ts) ELSE ts END,
    seen OR kind <> 'G', recv_wall_ns,
    CASE WHEN kind = 'S' THEN '-' WHEN stale THEN why
         WHEN kind = 'G' THEN CASE WHEN seen THEN 'G' ELSE '-' END
         WHEN now_count < 0 THEN 'N' WHEN crossed THEN 'C' ELSE '-' END,
    CASE WHEN applied THEN now_count END, images + CASE WHEN kind = 'S' THEN 1 ELSE 0 END, kind
  FROM (
    SELECT *, kind = 'D' AND NOT stale AND now_count >= 0 AS applied,
      kind = 'D' AND NOT stale AND now_count > 0 AND len(list_filter(map_entries(lv), lambda x:
        x.value > 0 AND CASE WHEN side = 0 THEN x.key < 0 AND -x.key <= price_e4
                             ELSE x.key > 0 AND x.key >= price_e4 END)) > 0 AS crossed
    FROM (
      SELECT r.ticker, e.n, r.lv, r.stale, r.ts, r.seen, r.why, r.images, e.kind, e.side, e.price_e4,
        e.size_e2, e.ts_ms, e.recv_wall_ns, e.conn_id,
        CAST(CASE WHEN e.side = 0 THEN e.price_e4 ELSE -e.price_e4 END AS INTEGER) AS key,
        coalesce(r.lv[CAST(CASE WHEN e.side = 0 THEN e.price_e4 ELSE -e.price_e4 END AS INTEGER)], 0)
          + e.delta_e2 AS now_count
      FROM {name} r JOIN {name}_ev e ON e.ticker = r.ticker AND e.n = r.n + 1)))"""


_FROM_NOTHING = """SELECT ticker, any_value(conn_id) AS conn_id, CAST(MAP([], []) AS MAP(INTEGER, BIGINT)) AS lv,
  TRUE AS stale, CAST(NULL AS BIGINT) AS ts FROM feed WHERE kind IN ('S','D') {cond} GROUP BY ticker"""
_BEFORE = f"AND recv_wall_ns <= {shared.MIDDLE_NS}"
_AFTER = f"AND recv_wall_ns > {shared.MIDDLE_NS}"


def _last(name: str) -> str:
    return f"""{name}_end AS (SELECT ticker, max(n) AS steps, arg_max(lv, n) AS lv, arg_max(stale, n) AS stale,
  arg_max({{'t': ts}}, n).t AS ts FROM {name} GROUP BY ticker),
{name}_lv AS (SELECT ticker, CAST(CASE WHEN x.key > 0 THEN 0 ELSE 1 END AS TINYINT) AS side,
  abs(x.key) AS price_e4, x.value AS count_e2
  FROM (SELECT ticker, unnest(map_entries(lv)) AS x FROM {name}_end) WHERE x.value > 0)"""


_FULL = f"WITH RECURSIVE {FEED_SQL}, {_fold('f', 'feed', _FROM_NOTHING.format(cond=''))}, {_last('f')}"
_MID = _fold("h", "feed", _FROM_NOTHING.format(cond=_BEFORE), _BEFORE)
_BOTH = f"{_FULL}, {_MID}, {_last('h')}"
_TOP = """top AS (SELECT ticker, max(price_e4) FILTER (side = 0) AS best_bid,
  coalesce(arg_max(count_e2, price_e4) FILTER (side = 0), 0) AS bid_size,
  min(price_e4) FILTER (side = 1) AS best_ask,
  coalesce(arg_min(count_e2, price_e4) FILTER (side = 1), 0) AS ask_size,
  count(*) FILTER (side = 0) AS bid_levels, count(*) FILTER (side = 1) AS ask_levels
  FROM {lv} GROUP BY ticker)"""
_SUMMARY = """SELECT e.ticker, e.stale, e.ts AS last_ts_ms, best_bid, coalesce(bid_size, 0) AS bid_size,
  best_ask, coalesce(ask_size, 0) AS ask_size, coalesce(bid_levels, 0) AS bid_levels,
  coalesce(ask_levels, 0) AS ask_levels FROM {end} e LEFT JOIN top USING (ticker)"""
_RANKED = """SELECT *, row_number() OVER (PARTITION BY ticker, side
  ORDER BY CASE WHEN side = 0 THEN -price_e4 ELSE price_e4 END) AS rank FROM f_lv"""
_DIFF = """SELECT ticker, side, price_e4, coalesce(h.count_e2, 0) AS count_a, coalesce(f.count_e2, 0) AS count_b
  FROM h_lv h FULL JOIN f_lv f USING (ticker, side, price_e4)
  WHERE coalesce(h.count_e2, 0) <> coalesce(f.count_e2, 0)"""
_MIX = """m1 AS (SELECT ticker, (CAST(side AS UHUGEINT) << 63) + (CAST(price_e4 AS UHUGEINT) << 44)
    + CAST(count_e2 AS UHUGEINT) AS z FROM f_lv),
m2 AS (SELECT ticker, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM m1),
m3 AS (SELECT ticker, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM m2)"""
_STATES = """st AS (SELECT ticker, n, wall, lv, stale, images,
  lead(wall) OVER (PARTITION BY ticker ORDER BY n) AS next_wall FROM f WHERE n > 0)"""
_BIN = 21_600_000_000_000
# Every bin's last state at or before its end, for bins not before a market's first image.
_BINNED = f"""bins AS (SELECT b.bin, s.ticker, arg_max(s.lv, s.n) AS lv, arg_max(s.images, s.n) AS images
  FROM range({BINS}) b(bin) JOIN (SELECT * FROM f WHERE n > 0) s
    ON (s.wall - {EPOCH_2024_NS}) // {_BIN} <= b.bin
  GROUP BY 1, 2 HAVING arg_max(s.images, s.n) > 0)"""

ORACLE = {
    "books_at": f"{_FULL} SELECT ticker, side, price_e4, count_e2 FROM f_lv",
    "book_status": f"{_FULL} SELECT ticker, stale, ts AS last_ts_ms FROM f_end",
    "top_of_book": f"{_FULL}, {_TOP.format(lv='f_lv')} {_SUMMARY.format(end='f_end')}",
    "book_depth": f"{_FULL} SELECT * FROM ({_RANKED}) WHERE rank <= 5",
    "book_images": f"""{_FULL} SELECT ticker,
      coalesce(string_agg(concat(price_e4, ':', count_e2), ',' ORDER BY rank) FILTER (side = 0), '') AS bids,
      coalesce(string_agg(concat(price_e4, ':', count_e2), ',' ORDER BY rank) FILTER (side = 1), '') AS asks
      FROM ({_RANKED}) WHERE rank <= 20 GROUP BY ticker""",
    "book_ladder": f"""{_FULL}, shown AS (SELECT * FROM ({_RANKED}) WHERE rank <= 10),
      per AS (SELECT ticker, min(price_e4) FILTER (side = 1) - max(price_e4) FILTER (side = 0) AS spread_e4,
        greatest(1, max(count_e2)) AS largest FROM shown GROUP BY ticker)
      SELECT ticker, side, rank, price_e4, count_e2, spread_e4,
        round(greatest(2.0, CAST(count_e2 AS DOUBLE) / largest * 100.0), 6) AS bar_pct FROM shown JOIN per USING (ticker)""",
    "level_sizes": f"""{_FULL} SELECT d.ticker, d.side, d.price_e4, coalesce(f_lv.count_e2, 0) AS count_e2
      FROM (SELECT DISTINCT ticker, side, price_e4 FROM feed WHERE kind = 'D') d
      LEFT JOIN f_lv USING (ticker, side, price_e4)""",
    "book_checksums": f"""{_FULL}, {_MIX} SELECT ticker,
      CAST(sum(CAST(xor(z, z >> 31) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS checksum FROM m3 GROUP BY ticker""",
    "book_diff": f"{_BOTH} {_DIFF}",
    "book_diff_summary": f"""{_BOTH} SELECT ticker, count(*) AS mismatched_levels,
      max(abs(count_a - count_b)) AS max_abs_diff_e2 FROM ({_DIFF}) GROUP BY ticker""",
    "keyframe_rows": f"""WITH RECURSIVE {FEED_SQL}, {_MID}, {_last('h')}
      SELECT e.ticker, CAST(coalesce(side, -1) AS TINYINT) AS side, coalesce(price_e4, 0) AS price_e4,
        coalesce(count_e2, 0) AS count_e2, {shared.MIDDLE_NS} AS as_of_recv_ns, e.ts AS last_ts_ms, e.stale
      FROM h_end e LEFT JOIN h_lv USING (ticker)""",
    "replay_from_keyframe": f"""WITH RECURSIVE {FEED_SQL}, {_MID}, {_last('h')},
      {_fold('k', 'feed', f'''SELECT u.ticker, u.conn_id,
        coalesce(h_end.lv, CAST(MAP([], []) AS MAP(INTEGER, BIGINT))) AS lv, coalesce(h_end.stale, TRUE) AS stale,
        h_end.ts AS ts FROM (SELECT ticker, any_value(conn_id) AS conn_id FROM feed
          WHERE kind IN ('S','D') GROUP BY ticker) u LEFT JOIN h_end USING (ticker)''', _AFTER)},
      {_last('k')}, {_TOP.format(lv='k_lv')} {_SUMMARY.format(end='k_end')}""",
    "snapshot_images": f"WITH {FEED_SQL} SELECT ticker, event_id AS seq, 20 AS levels, TRUE AS valid FROM feed WHERE kind = 'S'",
    "host_restarts": f"""WITH {FEED_SQL} SELECT CAST(recv_mono_ns // (5 * {NS_PER_DAY}) AS INTEGER) AS stretch,
      count(*) AS rows, min(recv_wall_ns) AS first_wall FROM feed GROUP BY 1""",
    "ordered_stream": f"""WITH {FEED_SQL} SELECT CASE kind WHEN 'D' THEN 'delta' WHEN 'T' THEN 'trade' ELSE 'gap' END AS stream,
      CASE WHEN kind <> 'G' THEN ticker END AS ticker, recv_mono_ns, event_id AS seq FROM feed WHERE kind <> 'S'""",
    "epoch_cuts": f"""{_FULL}, ends AS (SELECT ticker, images, arg_max(why, n) AS kind FROM f WHERE images > 0 GROUP BY 1, 2)
      SELECT kind, count(*) AS epochs FROM ends GROUP BY 1""",
    "level_changes": f"""{_FULL} SELECT f.ticker, f.wall AS recv_wall_ns, e.side, e.price_e4, e.delta_e2, f.now_count AS count_e2
      FROM f JOIN f_ev e ON e.ticker = f.ticker AND e.n = f.n WHERE f.kind = 'D' AND f.now_count IS NOT NULL""",
    "top_of_book_timeline": f"""{_FULL},
      prev AS (SELECT ticker, n, wall, lv, stale, kind, now_count, lag(lv) OVER (PARTITION BY ticker ORDER BY n) AS was
        FROM f),
      -- A change is part of the timeline when it alters which levels rest, and leaves the book fresh.
      moved AS (SELECT *, list_sort(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0), lambda x: x.key)) AS open_now,
          list_sort(list_transform(list_filter(map_entries(was), lambda x: x.value > 0), lambda x: x.key)) AS open_was
        FROM prev WHERE n > 0 AND NOT stale AND kind <> 'G'),
      kept AS (SELECT * FROM moved WHERE kind = 'S' OR open_now <> open_was)
      SELECT ticker, wall // {NS_PER_DAY} AS day,
        arg_max({{'b': list_max(list_filter(open_now, lambda x: x > 0))}}, n).b AS best_bid,
        arg_max({{'a': -list_max(list_filter(open_now, lambda x: x < 0))}}, n).a AS best_ask
      FROM kept GROUP BY 1, 2""",
    "row_totals": f"""{_FULL}, ch AS (SELECT f.ticker, f.images AS epoch, f.n, f.wall, f.kind, f.lv, abs(e.price_e4) // 100 AS row
        FROM f JOIN f_ev e ON e.ticker = f.ticker AND e.n = f.n
        WHERE f.kind = 'D' AND f.now_count IS NOT NULL AND f.images > 0
        UNION ALL SELECT f.ticker, f.images, f.n, f.wall, f.kind, f.lv, r.row FROM f,
          (SELECT 40 + i AS row FROM range(10) q(i) UNION ALL SELECT 51 + i FROM range(10) q(i)) r WHERE f.kind = 'S')
      SELECT ticker, CAST(epoch AS BIGINT) AS epoch, CAST(row AS INTEGER) AS row, (wall - {EPOCH_2024_NS}) // {_BIN} AS bin,
        CAST(arg_max(coalesce(list_sum(list_transform(list_filter(map_entries(lv), lambda x: abs(x.key) // 100 = row), lambda x: x.value)), 0), n) AS BIGINT) AS total_e2
      FROM ch GROUP BY 1, 2, 3, 4""",
    "heatmap_cells": f"""{_FULL}, {_BINNED}, cell AS (SELECT ticker, bin, abs(x.key) // 100 AS row, sum(x.value) AS total_e2
        FROM (SELECT ticker, bin, unnest(map_entries(lv)) AS x FROM bins) GROUP BY 1, 2, 3)
      SELECT ticker, bin, CAST(row AS INTEGER) AS row, CAST(total_e2 AS BIGINT) AS total_e2, round(ln(1 + total_e2 / 100.0), 6) AS depth
      FROM cell WHERE total_e2 > 0""",
    "heatmap_columns": f"""{_FULL}, {_BINNED}, imaged AS (SELECT DISTINCT ticker FROM f WHERE images > 0)
      SELECT i.ticker, b.bin,
        list_max(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0 AND x.key > 0), lambda x: x.key)) AS best_bid,
        -list_max(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0 AND x.key < 0), lambda x: x.key)) AS best_ask
      FROM imaged i CROSS JOIN range({BINS}) b(bin) LEFT JOIN bins ON bins.ticker = i.ticker AND bins.bin = b.bin""",
    "heatmap_status": f"""{_FULL}, imaged AS (SELECT DISTINCT ticker FROM f WHERE images > 0),
      held AS (SELECT ticker, CASE WHEN images = 0 THEN 2 WHEN stale THEN 1 ELSE 0 END AS status,
        CASE WHEN n = 0 THEN 0 ELSE (wall - {EPOCH_2024_NS}) // {_BIN} END AS a,
        coalesce((lead(wall) OVER (PARTITION BY ticker ORDER BY n) - {EPOCH_2024_NS}) // {_BIN}, {BINS - 1}) AS b FROM f)
      SELECT h.ticker, r.bin, CAST(max(status) AS INTEGER) AS status FROM held h JOIN imaged USING (ticker)
      JOIN range({BINS}) r(bin) ON r.bin BETWEEN h.a AND h.b GROUP BY 1, 2""",
    "heatmap_samples": f"""WITH {FEED_SQL}, k AS (SELECT count(DISTINCT ticker) AS n FROM feed WHERE kind IN ('S','D'))
      SELECT bin, CASE WHEN bin >= 20 THEN n ELSE 0 END AS drawn, CASE WHEN bin >= 20 THEN least(bin, 99) END AS "column",
        CASE WHEN bin < 20 THEN n ELSE 0 END AS unknown_before FROM k, range(140) b(bin)""",
    "trade_points": f"""WITH {FEED_SQL}, {TRADES_SQL} SELECT ticker, trade_id,
      round((recv_wall_ns - {EPOCH_2024_NS}) / 250000000.0, 3) AS bin, price_e4, count_e2 / 100.0 AS contracts, taker_side FROM trades""",
    "recent_trades": f"""WITH {FEED_SQL}, {TRADES_SQL} SELECT ticker, trade_id, nth, price_e4, count_e2 FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY recv_wall_ns DESC, trade_id DESC) AS nth FROM trades) WHERE nth <= 12""",
    "microprices": f"""{_FULL}, {_TOP.format(lv='f_lv')} SELECT e.ticker, CASE WHEN best_bid IS NOT NULL AND best_ask IS NOT NULL
        THEN (best_bid * ask_size + best_ask * bid_size) // (bid_size + ask_size) END AS microprice_e4
      FROM f_end e LEFT JOIN top USING (ticker)""",
    "header_quotes": f"""{_FULL}, {TRADES_SQL}, {_TOP.format(lv='f_lv')},
      lt AS (SELECT ticker, arg_max(price_e4, recv_wall_ns) AS l FROM trades GROUP BY 1)
      SELECT u.ticker, coalesce(best_bid, l - 100, 1) AS bid, coalesce(best_ask, l + 100, 9999) AS ask, coalesce(l, 5000) AS last
      FROM (SELECT DISTINCT ticker FROM feed) u LEFT JOIN top USING (ticker) LEFT JOIN lt USING (ticker)""",
    "trade_quotes": f"""{_FULL}, {TRADES_SQL},
      {_STATES.replace('st AS', 'st0 AS')},
      fresh AS (SELECT ticker, wall, CASE WHEN stale THEN NULL ELSE {{
        'b': list_max(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0 AND x.key > 0), lambda x: x.key)),
        'a': -list_max(list_transform(list_filter(map_entries(lv), lambda x: x.value > 0 AND x.key < 0), lambda x: x.key))}} END AS q
        FROM f WHERE n > 0 AND NOT stale)
      SELECT t.trade_id, q.b AS best_bid, q.a AS best_ask FROM trades t
      ASOF LEFT JOIN fresh ON fresh.ticker = t.ticker AND fresh.wall < t.recv_wall_ns""",
}
ORACLE["impossible_trades"] = ORACLE["trade_quotes"].rsplit("SELECT t.trade_id", 1)[0] + """, tq AS (
      SELECT t.ticker, t.taker_side, t.price_e4, fresh.ticker IS NOT NULL AS found, q.b AS b, q.a AS a FROM trades t
      ASOF LEFT JOIN fresh ON fresh.ticker = t.ticker AND fresh.wall < t.recv_wall_ns)
      SELECT ticker, count(*) FILTER (found AND CASE WHEN taker_side = 0 THEN price_e4 < a ELSE price_e4 > b END) AS impossible,
        count(*) FILTER (found AND CASE WHEN taker_side = 0 THEN a ELSE b END IS NOT NULL) AS judged FROM tq GROUP BY 1"""
ORACLE["session_maxima"] = (
    ORACLE["row_totals"].replace("SELECT ticker, CAST(epoch AS BIGINT)", ", rt AS (SELECT ticker, CAST(epoch AS BIGINT)")
    + f"""), {TRADES_SQL} SELECT ticker, big.m AS max_trade_contracts, big.c AS trades, deep.m AS max_row_contracts
      FROM (SELECT ticker, max(count_e2) / 100.0 AS m, count(*) AS c FROM trades GROUP BY 1) big
      FULL JOIN (SELECT ticker, max(total_e2) / 100.0 AS m FROM rt GROUP BY 1) deep USING (ticker)"""
)

for _name in ("books_at", "book_status", "top_of_book_timeline"):
    ORACLE[f"{_name}_sliced"] = ORACLE[_name]
ORACLE["books_at_hot_minute"] = ORACLE["books_at"]
_CALM = f"{FEED_SQL.replace('feed AS', 'busy AS', 1)}, feed AS (SELECT * FROM busy WHERE kind <> 'G' OR event_id % {shared.CALM} = 0)"
for _name in ("epoch_cuts", "top_of_book_timeline"):
    ORACLE[f"{_name}_calm"] = ORACLE[_name].replace(FEED_SQL, _CALM)
# Each clock only rises, and they are further apart than a restart's drop: a restart is a step from the later to the earlier,
# in the order of wall time and reading, by more than that drop.
ORACLE["host_restarts_interleaved"] = f"""WITH {FEED_SQL}, r AS (SELECT recv_wall_ns AS wall, conn_id % 2 AS late,
      recv_mono_ns + {_APART_NS} * (conn_id % 2) AS mono FROM feed)
      SELECT wall, mono FROM r WINDOW o AS (ORDER BY wall, mono)
      QUALIFY late = 0 AND lag(late) OVER o = 1 AND mono < lag(mono) OVER o - {RESTART_DROP_NS}"""
_EARLY = f"AND recv_wall_ns <= {shared.QUARTER_NS}"
ORACLE["keyframe_agreement"] = f"""WITH RECURSIVE {FEED_SQL}, {_MID}, {_last('h')},
      {_fold('q', 'feed', _FROM_NOTHING.format(cond=_EARLY), _EARLY)}, {_last('q')},
      {_fold('k', 'feed', f'''SELECT u.ticker, u.conn_id, coalesce(q_end.lv, CAST(MAP([], []) AS MAP(INTEGER, BIGINT))) AS lv,
        coalesce(q_end.stale, TRUE) AS stale, q_end.ts AS ts FROM (SELECT ticker, any_value(conn_id) AS conn_id FROM feed
          WHERE kind IN ('S','D') {_BEFORE} GROUP BY ticker) u LEFT JOIN q_end USING (ticker)''', f"AND recv_wall_ns > {shared.QUARTER_NS}", _BEFORE)}, {_last('k')},
      d AS (SELECT ticker, count(*) AS n FROM h_lv h FULL JOIN k_lv k USING (ticker, side, price_e4)
        WHERE coalesce(h.count_e2, 0) <> coalesce(k.count_e2, 0) GROUP BY ticker)
      SELECT h.ticker, coalesce(d.n, 0) AS differences, h.stale = k.stale AS same_flag, d.n IS NULL AND h.stale = k.stale AS agrees
      FROM h_end h JOIN k_end k USING (ticker) LEFT JOIN d USING (ticker)"""
_ADDED = ORACLE["level_changes"].replace(FEED_SQL, _CALM).replace("SELECT f.ticker, f.wall AS recv_wall_ns", ", lc AS (SELECT f.ticker, f.wall AS recv_wall_ns")
ORACLE["time_to_fill"] = f"""{_ADDED}),
      {TRADES_SQL}, tv AS (SELECT ticker, 1 - taker_side AS side, price_e4, recv_wall_ns AS w,
        sum(count_e2) OVER (PARTITION BY ticker, taker_side, price_e4 ORDER BY recv_wall_ns) AS done FROM trades WHERE count_e2 > 0)
      SELECT ticker, CAST(side AS INTEGER) AS side, price_e4, recv_wall_ns - {EPOCH_2024_NS} AS placed_ns, delta_e2 AS ahead_e2,
        (SELECT min(t.w) FROM tv t WHERE t.ticker = lc.ticker AND t.side = lc.side AND t.price_e4 = lc.price_e4 AND t.w > lc.recv_wall_ns
          AND t.done >= lc.delta_e2 + coalesce((SELECT max(b.done) FROM tv b WHERE b.ticker = lc.ticker AND b.side = lc.side
            AND b.price_e4 = lc.price_e4 AND b.w <= lc.recv_wall_ns), 0)) - recv_wall_ns AS wait_ns
      FROM lc WHERE delta_e2 > 0"""
# At one reading, tables come in the order given; rows of one table, which have one exchange time there, by their sequence.
ORACLE["merged_stream"] = f"""WITH {FEED_SQL} SELECT row_number() OVER (ORDER BY recv_wall_ns, CASE kind WHEN 'D' THEN 0 WHEN 'S' THEN 1 WHEN 'T' THEN 2 ELSE 3 END, event_id) - 1 AS position,
      CASE kind WHEN 'D' THEN 'delta' WHEN 'S' THEN 'image' WHEN 'T' THEN 'trade' ELSE 'gap' END AS stream,
      CASE WHEN kind <> 'G' THEN ticker END AS ticker, CAST(recv_mono_ns // (5 * {NS_PER_DAY}) AS INTEGER) AS stretch,
      recv_mono_ns % (5 * {NS_PER_DAY}) AS recv_mono_ns, event_id AS seq FROM feed"""
