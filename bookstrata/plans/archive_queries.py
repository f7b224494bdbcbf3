"""Record interpretation, integrity, audits, storage and retention over the sample tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import hour_label
from bookstrata.functions.exact import format_count, format_price
from bookstrata.operators import archive_audits as AA
from bookstrata.operators import audits as A
from bookstrata.operators import books as B
from bookstrata.operators import integrity as I
from bookstrata.operators import records as R
from bookstrata.operators import retention as P
from bookstrata.operators import sequences as Q
from bookstrata.plans import shared
from bookstrata.plans.book_queries import _CALM, _FULL
from bookstrata.plans.book_queries import ORACLE as BOOK_ORACLE
from bookstrata.plans.catalog import Catalog
from bookstrata.session import materialize, scratch_path
from bookstrata.sources import manifests as M
from bookstrata.sources import sample
from bookstrata.sources import segments as Sg
from bookstrata.sources import tables as T
from bookstrata.sources.sample import EPOCH_2024_NS, FEED_SQL, TRADES_SQL

S = 1_000_000_000
OUTCOMES = ("exact", "consistent", "inconsistent", "undecidable")


# ------------------------------------------------------------------ raw records


def raw_records(spark, sf):
    """The feed as raw records: JSON payloads, some of them broken, in one segment per hour and connection."""
    f = sample.feed(spark, sf)
    e, kind = F.col("event_id"), F.col("kind")
    form = (
        F.when((F.col("event_type") == "click") & (e % 6 == 0), "C")
        .when((F.col("event_type") == "signup") & (e % 4 == 1), "A")
        .otherwise(kind)
    )
    frame = lambda name, **m: F.to_json(F.struct(
        name.alias("type"), F.col("sid"), e.alias("seq"), F.struct(*[v.alias(k) for k, v in m.items()]).alias("msg")))
    ticker = F.col("ticker")
    delta = frame(
        F.lit("orderbook_delta"), market_ticker=ticker, price_dollars=format_price("price_e4"),
        delta_fp=F.when(e % 89 == 0, "x").otherwise(format_count("delta_e2")),
        side=F.when(F.col("side") == 0, "yes").otherwise("no"), ts_ms=F.col("ts_ms"),
    )
    pairs = lambda first: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.array(format_price(F.lit(first) + 100 * k), format_count(F.lit(100_000) + F.col("size_e2"))))
    image = frame(F.lit("orderbook_snapshot"), market_ticker=ticker, yes_dollars_fp=pairs(4000), no_dollars_fp=pairs(5100))
    trade = frame(
        F.when(e % 83 == 0, "novel").otherwise("trade"), trade_id=F.concat(F.lit("t"), e.cast("string")), market_ticker=ticker,
        yes_price_dollars=format_price(4000 + 100 * (e % 21)), no_price_dollars=format_price(6000 - 100 * (e % 21)),
        count_fp=format_count("size_e2"), taker_book_side=F.when(e % 2 == 0, "bid").otherwise("ask"), ts_ms=F.col("ts_ms"),
        is_block_trade=e % 50 == 0,
    )
    gap = F.to_json(F.struct("sid", e.alias("expected_seq"), (e + 1).alias("got_seq")))
    event = F.element_at(F.array(*[F.lit(x) for x in ("open", "close", "clock_jump", "writer_overflow", "error", "open")]), (F.expr("event_id div 6") % 6 + 1).cast("int"))
    conn = F.to_json(F.struct(
        event.alias("event"), F.when(e % 5 == 0, "stopped").otherwise("lost").alias("detail"), (e % 10).alias("dropped"),
        (F.lit(9 * S) + e * 100_000_000).alias("wall_ns_delta"), F.lit(2 * S).alias("mono_ns_delta"),
    ))
    audit = F.to_json(F.struct(
        ticker.alias("ticker"), F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), (F.expr("event_id div 4") % 4 + 1).cast("int")).alias("outcome"),
        F.lit(20).alias("levels_rest"), F.col("recv_mono_ns").alias("send_mono_ns"), F.col("recv_wall_ns").alias("send_wall_ns"),
        F.col("recv_mono_ns").alias("window_open_mono_ns"), F.col("recv_mono_ns").alias("window_close_mono_ns"),
        F.lit(0).alias("window_events"), (e % 7).alias("mismatched_levels"),
    ))
    whole = F.when(form == "D", delta).when(form == "S", image).when(form == "T", trade).when(form == "G", gap).when(form == "C", conn).otherwise(audit)
    broken = (e % 97 == 0) & form.isin("D", "S", "T")
    label = hour_label("recv_wall_ns")
    return f.select(
        F.concat(F.substring(label, 1, 10), F.lit("/"), F.substring(label, 12, 2), F.lit("/conn-"), F.col("conn_id").cast("string"), F.lit(".zst")).alias("segment"),
        e.alias("ordinal"), F.when(form.isin("D", "S", "T"), 1).when(form == "G", 3).when(form == "C", 4).otherwise(5).cast("tinyint").alias("kind"),
        F.col("conn_id").cast("int").alias("conn_id"), "recv_mono_ns", "recv_wall_ns",
        F.when(broken, "oops").otherwise(whole).cast("binary").alias("payload"), F.lit(True).alias("use_yes_price"),
        F.lit(None).cast("string").alias("msg_text"),
    )


def _segments(spark, sf):
    """The sample written as segment files by the executors, and read back."""

    def make():
        root = scratch_path(spark, "segments")
        sample.write_segments(raw_records(spark, sf), root)
        rows = materialize(Sg.read_segments(spark, root), "raw")
        return rows, [rows]

    return shared.once(spark, sf, "segments", make)


def segment_records(spark, sf):
    rows = Sg.records(_segments(spark, sf))
    return rows.select("segment", "ordinal", "kind", "conn_id", "recv_mono_ns", "recv_wall_ns")


def segment_facts(spark, sf):
    facts = Sg.segment_facts(_segments(spark, sf))
    return facts.select("segment", "hour_label", "records", "first_recv_wall_ns", "last_recv_wall_ns", "truncated", "corrupt", "conn_id")


def _classified(spark, sf):
    def make():
        rows = materialize(R.classify(raw_records(spark, sf)), "classified")
        return rows, [rows]

    return shared.once(spark, sf, "classified", make)


def _facts(spark, sf):
    """Per segment: records and first and last wall time."""
    return raw_records(spark, sf).groupBy("segment").agg(
        F.count(F.lit(1)).alias("records"), F.max_by("recv_wall_ns", "ordinal").alias("last_recv_wall_ns"),
        F.first(hour_label("recv_wall_ns")).alias("hour_label"),
    )


def record_accounting(spark, sf):
    rows = R.accounting(_classified(spark, sf))
    return rows.groupBy("kind", "outcome", "key").agg(F.sum("records").alias("records"))


def accounting_check(spark, sf):
    """Hours in which some record is not accounted for; there must be none."""
    return R.accounting_check(R.accounting(R.classify(raw_records(spark, sf))), _facts(spark, sf))


def failure_samples(spark, sf):
    rows = R.failure_samples(_classified(spark, sf), 2)
    return rows.select("hour_label", "key", "segment", "ordinal", "nth")


def decoded_deltas(spark, sf):
    return R.stored(R.delta_rows(_classified(spark, sf)), "deltas").select("ticker", "seq", "ts_ms", "conn_id", "side", "price_e4", "delta_e2")


def decoded_snapshots(spark, sf):
    return R.stored(R.snapshot_rows(_classified(spark, sf)), "snapshots").select("ticker", "seq", "side", "price_e4", "count_e2", "reason")


def decoded_trades(spark, sf):
    return R.stored(R.trade_rows(_classified(spark, sf)), "trades").select("ticker", "trade_id", "price_e4", "count_e2", "taker_side", "is_block")


def decoded_audits(spark, sf):
    return R.audit_rows(_classified(spark, sf)).select("ticker", "recv_wall_ns", "outcome", "mismatched_levels")


def gap_resolution(spark, sf):
    rows = I.gap_rows(_classified(spark, sf), _facts(spark, sf))
    return rows.select("conn_id", "recv_wall_ns", "expected_seq", "got_seq", "resolved_recv_wall_ns")


def gap_cost(spark, sf):
    rows = I.gap_facts(_classified(spark, sf), _facts(spark, sf))
    return I.gap_summary(rows).select("dt", "count", "market_seconds_affected", "market_seconds_observed")


def connection_spans(spark, sf):
    rows = I.connection_spans(_classified(spark, sf), _facts(spark, sf))
    return rows.select("segment", "conn_id", "start_wall_ns", "end_wall_ns", "opened", "closed")


def host_sleeps(spark, sf):
    return I.host_sleeps(_classified(spark, sf)).select("start_wall_ns", "end_wall_ns")


def overflow_dropped(spark, sf):
    return I.overflow_dropped(_classified(spark, sf))


def uptime(spark, sf):
    spans = I.connection_spans(_classified(spark, sf), _facts(spark, sf))
    return I.uptime(spans, I.host_sleeps(_classified(spark, sf))).select("dt", "seconds_recording")


def audit_summary(spark, sf):
    rows = I.audit_summary(R.audit_rows(_classified(spark, sf)).withColumn("dt", F.substring("hour_label", 1, 10)), ["dt"])
    return rows.select(
        "dt", "books_sampled", "books_exact", "books_consistent", "books_inconsistent", "books_undecidable", "levels_mismatched",
        F.col("consistency_ratio.num").alias("passed"), F.col("exact_ratio.den").alias("den"),
    )


def connection_status(spark, sf):
    c = _classified(spark, sf)
    rows = c.select("conn_id", "kind", F.col("conn.event").alias("event"), F.when(F.col("conn.event") == "writer_overflow", F.col("conn.dropped")).alias("dropped"))
    gaps = c.where((F.col("outcome") == "baked") & (F.col("key") == "gap")).select("conn_id")
    stale = shared.final_books(spark, sf).status.where("stale").select(
        F.expr("cast(regexp_extract(ticker, 'T([0-9]+)$', 1) as int) % 4").alias("conn_id")
    ).groupBy("conn_id").agg(F.count(F.lit(1)).alias("stale_books"))
    return I.connection_status(rows, gaps, stale)


# ------------------------------------------------------------------ sequences


def _messages(spark, sf):
    f = sample.feed(spark, sf)
    e = F.col("event_id")
    # Numbering the sample's users builds the test input; the operator under test has no such window.
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    numbered = f.withColumn("n", n).where(e % 97 != 0)
    seq = F.when(e % 107 == 0, None).when(e % 101 == 0, F.col("n") - 1).otherwise(F.col("n"))
    return numbered.select(
        F.col("user_id").cast("int").alias("conn_id"), "sid", e.alias("arrival"), seq.cast("bigint").alias("seq"), (e % 103 == 0).alias("reset"),
    )


def sequence_verdicts(spark, sf):
    rows = _messages(spark, sf).withColumn("block", F.expr("arrival div 4096"))
    out = Q.sequence_verdicts(rows, ["conn_id", "sid"], ["block"], ["arrival"], reset="reset")
    return out.select("conn_id", "arrival", "verdict", "expected_seq", "got_seq")


def gap_counters(spark, sf):
    return Q.gap_counters(sequence_verdicts(spark, sf), ["conn_id"])


def _bus(spark, sf):
    e = F.col("event_id")
    return sample.feed(spark, sf).where(e % 97 != 0).select(
        F.lit("p").alias("publisher"), e.alias("arrival"), F.expr("event_id div 4000").alias("bus_epoch"), (e % 4_000 + 1).alias("bus_seq"),
        F.expr("event_id div 4096").alias("block"), F.col("kind").alias("body"),
    )


def bus_continuity(spark, sf):
    out = Q.bus_continuity(_bus(spark, sf), ["publisher"], ["block"], ["arrival"])
    return out.select("arrival", "reset", "missed", "generation")


def bus_stats(spark, sf):
    out = Q.bus_continuity(_bus(spark, sf), ["publisher"], ["block"], ["arrival"])
    outcome = F.when(F.col("body") == "S", "refreshed").when(F.col("body") == "G", "error").when(F.col("reset").isNotNull(), "ignored").otherwise("applied")
    return Q.bus_stats(out.withColumn("outcome", outcome), ["publisher"])


def clock_jumps(spark, sf):
    """Host sleeps when a minute of monotonic time is lost every thousand events."""
    f = sample.feed(spark, sf).select(
        "conn_id", "event_id", "recv_wall_ns", (F.col("recv_mono_ns") - F.expr("event_id div 1000") * 60 * S).alias("recv_mono_ns"),
        F.expr("event_id div 4096").alias("block"),
    )
    return I.clock_jumps(f, ["conn_id"], ["block"], ["event_id"])


# ------------------------------------------------------------------ audits


def audit_windows(spark, sf):
    """Every image taken as an independent snapshot of a book that starts equal to it."""
    f = sample.feed(spark, sf)
    images = f.where(F.col("kind") == "S")
    day = 86_400 * S
    audits = images.select(
        F.col("event_id").alias("audit_id"), "ticker", F.col("recv_mono_ns").alias("reply_mono_ns"),
        (F.col("recv_mono_ns") - 2 * day).alias("window_open_mono_ns"), (F.col("recv_mono_ns") + day).alias("window_close_mono_ns"),
        (F.col("event_id") % 11 != 0).alias("has_book"), (F.col("event_id") % 13 == 0).alias("went_stale"),
    )
    levels = sample.snapshots(spark, sf).select(F.col("seq").alias("audit_id"), "side", "price_e4", "count_e2")
    # Sizes are made small numbers so that changes cancel now and then.
    changes = f.where(F.col("kind") == "D").select(
        "ticker", F.col("recv_mono_ns").alias("mono"), "side", (F.when(F.col("side") == 0, 4000).otherwise(5100) + 100 * (F.col("event_id") % 2)).cast("int").alias("price_e4"),
        F.when(F.col("event_id") % 3 == 0, F.lit(-5)).otherwise(F.lit(5)).cast("bigint").alias("delta_e2"),
    )
    joined = A.window_changes(audits, changes, 6 * 3_600 * S)
    order = Window.partitionBy("audit_id").orderBy("mono")
    events = joined.withColumn("idx", F.row_number().over(order).cast("bigint")).withColumn(
        "levels", F.lit(None).cast("array<struct<side:tinyint,price_e4:int,count_e2:bigint>>")
    )
    out = A.classify_windows(audits, levels, events, levels, max_events=25)
    return out.drop("ticker")


# The archive's audits: half a window, the steps by which replies miss their image, and changes a window may hold.
_HALF, _STEP, _MOST = 36 * 3_600 * S, 6 * 3_600 * S, 12


def audits_from_archive(spark, sf):
    """Every image of the calm feed as the REST book of an audit whose reply comes up to 18 hours before or after it."""
    reply = F.col("recv_mono_ns") + (F.col("event_id") % 7 - 3) * _STEP
    audits = sample.feed(spark, sf).where(F.col("kind") == "S").select(
        F.col("event_id").alias("audit_id"), "ticker", F.lit(0).alias("stretch"), (reply - _HALF).alias("window_open_mono_ns"),
        reply.alias("reply_mono_ns"), (reply + _HALF).alias("window_close_mono_ns"),
    )
    # One level of some snapshots is off by one, and some snapshots lack their asks.
    off = F.when((F.col("seq") % 11 == 0) & (F.col("price_e4") == 4000), 1).otherwise(0)
    rest = sample.snapshots(spark, sf).where((F.col("seq") % 13 != 0) | (F.col("side") == 0))
    rest = rest.select(F.col("seq").alias("audit_id"), "side", "price_e4", (F.col("count_e2") + off).alias("count_e2"))
    return AA.audits_from_archive(shared.calm_timeline(spark, sf), audits, rest, _MOST)


def rest_books(spark, sf):
    """Images as REST books, with NO bids to complement, zero counts and some malformed prices."""
    f = sample.feed(spark, sf).where(F.col("kind") == "S")
    pairs = lambda first, bad: F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.array(F.when(F.lit(bad) & (F.col("event_id") % 20 == 0) & (k == 2), "1.5").otherwise(format_price(F.lit(first) + 100 * k)), format_count(F.when(k == 3, 0).otherwise(F.col("size_e2")))),
    )
    books = f.select(F.col("event_id").alias("audit_id"), "ticker", pairs(4000, False).alias("yes_dollars"), pairs(4500, True).alias("no_dollars"))
    return A.rest_levels(books).select("audit_id", "side", "price_e4", "count_e2")


def level_texts(spark, sf):
    """Final books as JSON level lists, and the lists read back."""
    texts = shared.final_books(spark, sf).levels.groupBy("ticker").agg(A.levels_json().alias("text"))
    back = texts.select("ticker", F.inline(A.parse_levels_json(F.col("text"))))
    return back.select("ticker", "side", "price_e4", "count_e2")


# ------------------------------------------------------------------ storage


def _squeezed(df):
    """The month of the feed squeezed into twelve hours, so an archive of it has twelve partitions."""
    squeeze = lambda c, base: F.lit(base) + F.expr(f"({c} - {base}) div 60")
    return df.withColumn("recv_wall_ns", squeeze("recv_wall_ns", EPOCH_2024_NS)).withColumn("recv_mono_ns", F.expr("recv_mono_ns div 60")).withColumn(
        "hour_label", hour_label("recv_wall_ns")
    )


MIDDLE_SQUEEZED = EPOCH_2024_NS + (shared.MIDDLE_NS - EPOCH_2024_NS) // 60
END_SQUEEZED = EPOCH_2024_NS + 12 * 3_600 * S


def _archive(spark, sf):
    """An archive of the sample: three tables and one keyframe."""

    def make():
        root = scratch_path(spark, "archive")
        for name, rows in (("deltas", sample.deltas(spark, sf)), ("snapshots", sample.snapshots(spark, sf)), ("gaps", sample.gaps(spark, sf)), ("trades", sample.trades(spark, sf))):
            T.write_table(_squeezed(rows), root, name)
        middle = B.to_keyframe(shared.middle_books(spark, sf), MIDDLE_SQUEEZED)
        T.write_keyframe(middle, root)
        return root, [T.read_table(spark, root, n) for n in ("deltas", "snapshots", "gaps")]

    return shared.once(spark, sf, "archive", make)


def catalog_books(spark, sf):
    """Books at the end of a stored archive, rebuilt from its latest keyframe."""
    return B.book_summary(Catalog(spark, _archive(spark, sf)).books_at(END_SQUEEZED))


def stored_range(spark, sf):
    """Deltas received in the second quarter of the archive, read back through partition filters."""
    rows = T.read_table(spark, _archive(spark, sf), "deltas")
    t0 = EPOCH_2024_NS + 3 * 3_600 * S
    return T.scan(rows, t0, t0 + 3 * 3_600 * S, columns=["ticker", "seq", "price_e4", "delta_e2"])


def stored_trades(spark, sf):
    """Trades of each market stored and read back by a semi-join on half of the markets."""
    rows = T.read_table(spark, _archive(spark, sf), "trades")
    wanted = sample.feed(spark, sf).where(F.col("user_id") % 2 == 0).select("ticker")
    return T.scan(rows, EPOCH_2024_NS, END_SQUEEZED, tickers=wanted, columns=["ticker", "trade_id", "price_e4"])


def stored_keyframe(spark, sf):
    """The latest keyframe at or before the archive's end."""
    rows, _ = T.latest_keyframe(T.read_keyframes(spark, _archive(spark, sf)), END_SQUEEZED)
    return rows.select("ticker", "side", "price_e4", "count_e2", "stale")


# ------------------------------------------------------------------ retention


def _inventory(spark, sf):
    """Orders as raw segments of hours: four orders share a path's hour."""
    o = sample.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    hour = F.lpad((F.expr("o_orderkey div 4") % 24).cast("string"), 2, "0")
    dt = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.expr("o_orderkey div 96")).cast("int")), "yyyy-MM-dd")
    return o.select(k.alias("k"), dt.alias("dt"), hour.alias("hour"), F.concat(dt, F.lit("/"), hour, F.lit("/s"), k.cast("string"), F.lit(".zst")).alias("path"), F.col("o_custkey").alias("bytes"), k.cast("string").alias("sha256"))


RETENTION_NOW = 1_704_067_200 * S + 60 * 86_400 * S


def prune_decisions(spark, sf):
    k = F.col("k")
    inv = _inventory(spark, sf)
    disk = inv.where(k % 50 != 1).withColumn("bytes", F.col("bytes") + F.when(k % 60 == 2, 1).otherwise(0)).withColumn(
        "sha256", F.when(k % 40 == 4, None).when(k % 130 == 5, "other").otherwise(F.col("sha256")))
    listed = inv.where(k % 70 != 3)
    per = inv.groupBy("dt", "hour").agg(F.min("k").alias("first"))
    baked = per.where(F.col("first") % 13 != 0).select("dt", "hour", F.when(F.col("first") % 17 == 0, 0).otherwise(1).alias("bake_version"), F.when(F.col("first") % 19 == 0, 1).otherwise(0).alias("failures"))
    parts = per.select("dt", "hour", F.concat(F.lit("deltas/"), "dt", F.lit("/"), "hour").alias("path"), F.lit("a").alias("sha256"), "first")
    found = parts.where(F.col("first") % 23 != 0).withColumn("sha256", F.when(F.col("first") % 29 == 0, "b").otherwise(F.col("sha256")))
    pruned = inv.where((k % 50 == 1) & (k % 100 == 1)).select("path")
    out = P.prune_decisions(per.select("dt", "hour"), disk, found, baked, listed, parts, pruned, RETENTION_NOW, 24, 1)
    return out.select("dt", "hour", "prunable", F.array_join("reasons", ",").alias("reasons"), "bytes_freed")


def hours_to_bake(spark, sf):
    k = F.col("k")
    inv = _inventory(spark, sf)
    disk = inv.where(k % 50 != 1).withColumn("bytes", F.col("bytes") + F.when(k % 60 == 2, 1).otherwise(0))
    per = inv.groupBy("dt", "hour").agg(F.min("k").alias("first"))
    baked = per.where(F.col("first") % 13 != 0).select("dt", "hour", F.when(F.col("first") % 17 == 0, 0).otherwise(1).alias("bake_version"))
    parts = per.select("dt", "hour", F.concat("dt", "hour").alias("path"), "first")
    gone = per.where(F.col("first") % 31 == 0)
    return P.hours_to_bake(disk, parts.where(F.col("first") % 23 != 0), baked, inv, parts, gone, 1)


def table_totals(spark, sf):
    """Order lines as stored parts: rows, files and bytes per table and day."""
    li = sample.table(spark, sf, "lineitem")
    parts = li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("dt"), (F.col("l_orderkey") % 24).alias("hour"),
        F.element_at(F.array(F.lit("deltas"), F.lit("trades")), (F.col("l_linenumber") % 2 + 1).cast("int")).alias("table"),
        F.col("l_quantity").cast("bigint").alias("rows"), F.col("l_partkey").alias("bytes"),
    )
    return M.table_totals(parts)


def pruned_once(spark, sf):
    """Paths recorded as pruned twice keep their first record."""
    inv = _inventory(spark, sf).select("path", "bytes", "sha256", F.lit(100).cast("bigint").alias("pruned_wall_ns"), "k")
    first = inv.where(F.col("k") % 2 == 0).drop("k")
    second = inv.where(F.col("k") % 3 == 0).withColumn("pruned_wall_ns", F.lit(200).cast("bigint")).drop("k")
    return M.add_pruned(first, second).select("path", "bytes", "pruned_wall_ns")


def replaced_hours(spark, sf):
    """Hour facts after some hours were baked again."""
    old = _inventory(spark, sf).groupBy("dt", "hour").agg(F.sum("bytes").alias("bytes"), F.min("k").alias("first"))
    fresh = old.where(F.col("first") % 2 == 0).withColumn("bytes", F.lit(-1).cast("bigint"))
    return M.replace_hours(old, fresh).select("dt", "hour", "bytes")


QUERIES = {
    f.__name__: f
    for f in (
        segment_records, segment_facts, record_accounting, accounting_check, failure_samples, decoded_deltas, decoded_snapshots,
        decoded_trades, decoded_audits, gap_resolution, gap_cost, connection_spans, host_sleeps,
        overflow_dropped, uptime, audit_summary, connection_status, sequence_verdicts, gap_counters,
        bus_continuity, bus_stats, clock_jumps, audit_windows, audits_from_archive, rest_books, level_texts,
        catalog_books, stored_range, stored_trades, stored_keyframe, prune_decisions,
        hours_to_bake, table_totals, pruned_once, replaced_hours,
    )
}

# ------------------------------------------------------------------ comparison SQL

_LABEL = "strftime(make_timestamp(recv_wall_ns // 1000), '%Y-%m-%dT%H')"
_RAW = f"""{FEED_SQL}, form AS (SELECT *, CASE WHEN event_type = 'click' AND event_id % 6 = 0 THEN 'C'
    WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'A' ELSE kind END AS fm, {_LABEL} AS hl FROM feed),
rec AS (SELECT *, concat(hl[1:10], '/', hl[12:13], '/conn-', conn_id, '.zst') AS segment,
    CASE WHEN fm IN ('D','S','T') AND event_id % 97 = 0 THEN 'frame_envelope'
         WHEN fm = 'D' AND event_id % 89 = 0 THEN 'frame_payload'
         WHEN fm = 'T' AND event_id % 83 = 0 THEN 'frame_unknown_type' END AS failure,
    (['open','close','clock_jump','writer_overflow','error','open'])[(event_id // 6) % 6 + 1] AS ev,
    (['exact','consistent','inconsistent','undecidable'])[(event_id // 4) % 4 + 1] AS oc FROM form)"""
_MSGS = """msgs AS (SELECT segment, hl, ticker, event_id AS n, recv_wall_ns AS w, fm = 'S' AS image FROM rec WHERE fm IN ('D','S') AND failure IS NULL),
firsts AS (SELECT segment, hl, ticker, min(n) AS n0, arg_min(w, n) AS w0 FROM msgs GROUP BY 1, 2, 3),
ends AS (SELECT segment, arg_max(recv_wall_ns, event_id) AS w1 FROM rec GROUP BY 1),
gp AS (SELECT segment, conn_id, event_id AS n, recv_wall_ns AS w FROM rec WHERE fm = 'G')"""
_SPANS = """ce AS (SELECT segment, conn_id, event_id AS n, recv_wall_ns AS w, ev FROM rec WHERE fm = 'C' AND ev IN ('open','close')),
fr AS (SELECT segment, any_value(conn_id) AS conn_id, min(event_id) AS n, any_value(hl) AS hl, arg_max(recv_wall_ns, event_id) AS w1,
  arg_min(CASE WHEN fm = 'C' THEN ev ELSE '-' END, event_id) AS fe FROM rec GROUP BY 1),
marks AS (SELECT * FROM ce UNION ALL SELECT segment, conn_id, n - 1, epoch_us(strptime(hl, '%Y-%m-%dT%H')) * 1000, 'continued' FROM fr WHERE fe NOT IN ('open','error')),
led AS (SELECT *, lead(w) OVER o AS nw, lead(ev) OVER o AS ne FROM marks WINDOW o AS (PARTITION BY segment ORDER BY n)),
spans AS (SELECT led.segment, led.conn_id, w AS start_wall_ns, greatest(w, coalesce(nw, w1)) AS end_wall_ns, ev = 'open' AS opened, coalesce(ne = 'close', FALSE) AS closed
  FROM led JOIN fr USING (segment) WHERE ev <> 'close')"""
_SLEEPS = "sleeps AS (SELECT DISTINCT recv_wall_ns - (7000000000 + event_id * 100000000) AS a, recv_wall_ns AS b FROM rec WHERE fm = 'C' AND ev = 'clock_jump')"
_ISLANDS = """{out} AS (SELECT {k}, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY {k} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {src})) GROUP BY {k}, g)"""
_DAY = 86_400_000_000_000
_MSG = """num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM feed),
ms AS (SELECT CAST(user_id AS INTEGER) AS conn_id, event_id AS arrival, CASE WHEN event_id % 107 = 0 THEN NULL WHEN event_id % 101 = 0 THEN n - 1 ELSE n END AS seq,
  sum(CASE WHEN event_id % 103 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM num WHERE event_id % 97 <> 0),
bs AS (SELECT m.conn_id, m.arrival, m.seq, (SELECT max(o.seq) FROM ms o WHERE o.conn_id = m.conn_id AND o.era = m.era AND o.arrival < m.arrival) AS base FROM ms m),
vd AS (SELECT conn_id, arrival, CASE WHEN seq IS NULL THEN 'ok' WHEN base IS NULL THEN 'first' WHEN seq = base + 1 THEN 'ok' WHEN seq > base + 1 THEN 'gap' ELSE 'duplicate' END AS verdict,
  CASE WHEN seq <> base + 1 THEN base + 1 END AS expected_seq, CASE WHEN seq <> base + 1 THEN seq END AS got_seq FROM bs)"""
_BUS = """b AS (SELECT event_id AS arrival, event_id // 4000 AS e, event_id % 4000 + 1 AS s, kind, lag(event_id // 4000) OVER (ORDER BY event_id) AS pe,
  lag(event_id % 4000 + 1) OVER (ORDER BY event_id) AS ps FROM feed WHERE event_id % 97 <> 0),
bc AS (SELECT *, CASE WHEN pe IS NULL THEN 'start' WHEN e <> pe THEN 'epoch' WHEN s <> ps + 1 THEN 'gap' END AS reset,
  CASE WHEN pe IS NULL THEN 0 WHEN e <> pe THEN s - 1 WHEN s <> ps + 1 THEN greatest(0, s - ps - 1) ELSE 0 END AS missed FROM b)"""
_INV = """inv AS (SELECT o_orderkey AS k, strftime(DATE '2024-01-01' + CAST(o_orderkey // 96 AS INTEGER), '%Y-%m-%d') AS dt,
  lpad(CAST((o_orderkey // 4) % 24 AS VARCHAR), 2, '0') AS hour, o_custkey AS bytes FROM orders),
per AS (SELECT dt, hour, min(k) AS f FROM inv GROUP BY 1, 2)"""

ORACLE = {
    "segment_records": f"""WITH {_RAW} SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY event_id) - 1 AS ordinal,
      CAST(CASE fm WHEN 'G' THEN 3 WHEN 'C' THEN 4 WHEN 'A' THEN 5 ELSE 1 END AS TINYINT) AS kind, conn_id, recv_mono_ns, recv_wall_ns FROM rec""",
    "segment_facts": f"""WITH {_RAW} SELECT segment, any_value(hl) AS hour_label, count(*) AS records, arg_min(recv_wall_ns, event_id) AS first_recv_wall_ns,
      arg_max(recv_wall_ns, event_id) AS last_recv_wall_ns, FALSE AS truncated, CAST(NULL AS VARCHAR) AS corrupt, any_value(conn_id) AS conn_id FROM rec GROUP BY segment""",
    "record_accounting": f"""WITH {_RAW} SELECT CAST(CASE fm WHEN 'G' THEN 3 WHEN 'C' THEN 4 WHEN 'A' THEN 5 ELSE 1 END AS TINYINT) AS kind,
      CASE WHEN failure IS NOT NULL THEN 'failure' WHEN fm = 'C' THEN 'not_baked' ELSE 'baked' END AS outcome,
      coalesce(failure, CASE fm WHEN 'D' THEN 'orderbook_delta' WHEN 'S' THEN 'orderbook_snapshot' WHEN 'T' THEN 'trade' WHEN 'G' THEN 'gap' WHEN 'C' THEN 'connection' ELSE 'audit' END) AS key,
      count(*) AS records FROM rec GROUP BY 1, 2, 3""",
    "accounting_check": "SELECT '' AS hour_label, 0 AS accounted, 0 AS read WHERE FALSE",
    "failure_samples": f"""WITH {_RAW}, r AS (SELECT hl AS hour_label, failure AS key, segment, event_id AS ordinal,
      row_number() OVER (PARTITION BY hl, failure ORDER BY segment, event_id) AS nth FROM rec WHERE failure IS NOT NULL) SELECT * FROM r WHERE nth <= 2""",
    "decoded_deltas": f"WITH {_RAW} SELECT ticker, event_id AS seq, ts_ms, conn_id, side, price_e4, delta_e2 FROM rec WHERE fm = 'D' AND failure IS NULL",
    "decoded_snapshots": f"""WITH {_RAW}, im AS (SELECT *, row_number() OVER (PARTITION BY segment, ticker ORDER BY event_id) > 1 AS again FROM rec WHERE fm = 'S' AND failure IS NULL),
      life AS (SELECT segment, conn_id, hl, arg_min(CASE WHEN fm = 'C' THEN ev ELSE '-' END, event_id) IN ('open','error') AS opens FROM rec GROUP BY 1, 2, 3)
      SELECT ticker, event_id AS seq, CAST(CASE WHEN k < 10 THEN 0 ELSE 1 END AS TINYINT) AS side, CASE WHEN k < 10 THEN 4000 + 100*k ELSE 5100 + 100*(k-10) END AS price_e4,
        100000 + size_e2 AS count_e2, CAST(CASE WHEN again THEN 1 ELSE 0 END AS TINYINT) AS reason FROM im, range(20) q(k)""",
    "decoded_trades": f"WITH {_RAW} SELECT ticker, concat('t', event_id) AS trade_id, 4000 + 100*(event_id % 21) AS price_e4, size_e2 AS count_e2, event_id % 2 AS taker_side, event_id % 50 = 0 AS is_block FROM rec WHERE fm = 'T' AND failure IS NULL",
    "decoded_audits": f"WITH {_RAW} SELECT ticker, recv_wall_ns, oc AS outcome, event_id % 7 AS mismatched_levels FROM rec WHERE fm = 'A'",
    "gap_resolution": f"""WITH {_RAW}, {_MSGS}, wt AS (SELECT gp.segment, gp.n, (SELECT min(m.w) FROM msgs m WHERE m.segment = gp.segment AND m.ticker = f.ticker AND m.image AND m.n > gp.n) AS nx
      FROM gp JOIN firsts f ON f.segment = gp.segment AND f.n0 < gp.n),
      rs AS (SELECT segment, n, CASE WHEN count(*) = count(nx) THEN max(nx) END AS r FROM wt GROUP BY 1, 2)
      SELECT gp.conn_id, gp.w AS recv_wall_ns, gp.n AS expected_seq, gp.n + 1 AS got_seq, rs.r AS resolved_recv_wall_ns FROM gp LEFT JOIN rs USING (segment, n)""",
    "gap_cost": f"""WITH {_RAW}, {_MSGS}, ob AS (SELECT hl[1:10] AS dt, sum(greatest(0, w1 - w0)) AS o FROM firsts JOIN ends USING (segment) GROUP BY 1),
      pc AS (SELECT f.segment, f.hl, f.ticker, gp.w, gp.n, (SELECT count(*) FROM msgs m WHERE m.segment = f.segment AND m.ticker = f.ticker AND m.image AND m.n < gp.n) AS piece
        FROM firsts f JOIN gp ON gp.segment = f.segment AND gp.n > f.n0),
      fg AS (SELECT segment, hl, ticker, piece, min(n) AS n, arg_min(w, n) AS w FROM pc GROUP BY 1, 2, 3, 4),
      st AS (SELECT hl[1:10] AS dt, sum(greatest(0, coalesce((SELECT arg_min(m.w, m.n) FROM msgs m WHERE m.segment = fg.segment AND m.ticker = fg.ticker AND m.image AND m.n > fg.n), w1) - fg.w)) AS s
        FROM fg JOIN ends USING (segment) GROUP BY 1),
      ct AS (SELECT hl[1:10] AS dt, count(*) FILTER (fm = 'G') AS c FROM rec GROUP BY 1)
      SELECT dt, c AS count, CAST(coalesce(s, 0) // 1000000000 AS BIGINT) AS market_seconds_affected, CAST(coalesce(o, 0) // 1000000000 AS BIGINT) AS market_seconds_observed FROM ct LEFT JOIN st USING (dt) LEFT JOIN ob USING (dt)""",
    "connection_spans": f"WITH {_RAW}, {_SPANS} SELECT * FROM spans",
    "host_sleeps": f"WITH {_RAW}, {_SLEEPS} SELECT a AS start_wall_ns, b AS end_wall_ns FROM sleeps",
    "overflow_dropped": f"WITH {_RAW} SELECT hl AS hour_label, CAST(sum(event_id % 10) AS BIGINT) AS dropped FROM rec WHERE fm = 'C' AND ev = 'writer_overflow' GROUP BY 1",
    "uptime": f"""WITH {_RAW}, {_SPANS}, {_SLEEPS},
      jn AS (SELECT *, CASE WHEN opened OR coalesce(lag(closed) OVER o, TRUE) THEN 1 ELSE 0 END AS fresh FROM spans WINDOW o AS (PARTITION BY conn_id ORDER BY start_wall_ns, end_wall_ns)),
      js AS (SELECT 0 AS k, min(start_wall_ns) AS a, max(end_wall_ns) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY conn_id ORDER BY start_wall_ns, end_wall_ns ROWS UNBOUNDED PRECEDING) AS g FROM jn) GROUP BY conn_id, g),
      {_ISLANDS.format(out='up', k='k', src='js')}, sl0 AS (SELECT 0 AS k, a, b FROM sleeps), {_ISLANDS.format(out='sl', k='k', src='sl0')},
      days AS (SELECT 19723 + d AS day FROM range(31) r(d)),
      cv AS (SELECT day, greatest(a, day * {_DAY}) AS a, least(b, (day + 1) * {_DAY}) AS b FROM days JOIN up ON b > day * {_DAY} AND a < (day + 1) * {_DAY}),
      tot AS (SELECT day, sum(b - a) AS t FROM cv GROUP BY 1),
      lost AS (SELECT day, sum(least(cv.b, sl.b) - greatest(cv.a, sl.a)) AS t FROM cv JOIN sl ON sl.b > cv.a AND sl.a < cv.b GROUP BY 1)
      SELECT strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS dt, CAST((tot.t - coalesce(lost.t, 0)) // 1000000000 AS BIGINT) AS seconds_recording FROM tot LEFT JOIN lost USING (day)""",
    "audit_summary": f"""WITH {_RAW} SELECT hl[1:10] AS dt, count(*) FILTER (oc <> 'undecidable') AS books_sampled, count(*) FILTER (oc = 'exact') AS books_exact,
      count(*) FILTER (oc = 'consistent') AS books_consistent, count(*) FILTER (oc = 'inconsistent') AS books_inconsistent, count(*) FILTER (oc = 'undecidable') AS books_undecidable,
      CAST(coalesce(sum(event_id % 7) FILTER (oc <> 'undecidable'), 0) AS BIGINT) AS levels_mismatched, count(*) FILTER (oc IN ('exact', 'consistent')) AS passed,
      count(*) FILTER (oc <> 'undecidable') AS den FROM rec WHERE fm = 'A' GROUP BY 1""",
    "connection_status": f"""{_FULL}, {_RAW.split(", form AS", 1)[1].join(["form AS", ""])},
      sb AS (SELECT CAST(regexp_extract(ticker, 'T([0-9]+)$', 1) AS INTEGER) % 4 AS conn_id, count(*) AS n FROM f_end WHERE stale GROUP BY 1)
      SELECT CAST(rec.conn_id AS INTEGER) AS conn_id, count(*) FILTER (fm IN ('D','S','T')) AS frames, count(*) FILTER (fm = 'G') AS gaps,
        greatest(0, count(*) FILTER (fm = 'C' AND ev = 'open') - 1) AS reconnects, coalesce(max(sb.n), 0) AS stale_books,
        CAST(coalesce(sum(event_id % 10) FILTER (fm = 'C' AND ev = 'writer_overflow'), 0) AS BIGINT) AS sink_dropped
      FROM rec LEFT JOIN sb ON sb.conn_id = rec.conn_id GROUP BY 1""",
    "sequence_verdicts": f"WITH {FEED_SQL}, {_MSG} SELECT * FROM vd",
    "gap_counters": f"WITH {FEED_SQL}, {_MSG} SELECT conn_id, count(*) AS messages, count(*) FILTER (verdict = 'gap') AS gaps, count(*) FILTER (verdict = 'duplicate') AS duplicates FROM vd GROUP BY 1",
    "bus_continuity": f"WITH {FEED_SQL}, {_BUS} SELECT arrival, reset, missed, CAST(count(reset) OVER (ORDER BY arrival) AS BIGINT) AS generation FROM bc",
    "bus_stats": f"""WITH {FEED_SQL}, {_BUS} SELECT 'p' AS publisher, count(*) AS messages, count(reset) AS resets, CAST(sum(missed) AS BIGINT) AS missed, count(*) FILTER (kind = 'S') AS refreshes,
      count(*) FILTER (kind NOT IN ('S', 'G') AND reset IS NOT NULL) AS ignored, count(*) FILTER (kind = 'G') AS book_errors FROM bc""",
    "clock_jumps": f"""WITH {FEED_SQL}, d AS (SELECT conn_id, recv_wall_ns AS w, recv_wall_ns - lag(recv_wall_ns) OVER o AS dw,
      recv_mono_ns - (event_id // 1000) * 60000000000 - lag(recv_mono_ns - (event_id // 1000) * 60000000000) OVER o AS dm FROM feed WINDOW o AS (PARTITION BY conn_id ORDER BY event_id))
      SELECT conn_id, w - (dw - dm) AS start_wall_ns, w AS end_wall_ns FROM d WHERE dw - dm > 5000000000""",
    "audit_windows": f"""WITH {FEED_SQL}, au AS (SELECT event_id AS audit_id, ticker, recv_mono_ns AS m FROM feed WHERE kind = 'S'),
      e AS (SELECT a.audit_id, a.m, f.recv_mono_ns AS t, f.side * 2 + f.event_id % 2 AS lv, CASE WHEN f.event_id % 3 = 0 THEN -5 ELSE 5 END AS d,
        row_number() OVER (PARTITION BY a.audit_id ORDER BY f.recv_mono_ns) AS i FROM au a JOIN feed f ON f.ticker = a.ticker AND f.kind = 'D' AND f.recv_mono_ns BETWEEN a.m - 2 * {_DAY} AND a.m + {_DAY}),
      n AS (SELECT audit_id, count(e.i) AS c, count(e.i) FILTER (e.t <= e.m) AS reply FROM au LEFT JOIN e USING (audit_id) GROUP BY 1),
      s AS (SELECT n.audit_id, q.i, (SELECT count(*) FROM (SELECT sum(d) AS x FROM e WHERE e.audit_id = n.audit_id AND e.i <= q.i GROUP BY lv) WHERE x <> 0) AS wrong,
        (SELECT max(abs(x)) FROM (SELECT sum(d) AS x FROM e WHERE e.audit_id = n.audit_id AND e.i <= q.i GROUP BY lv) WHERE x <> 0) AS far FROM n JOIN range(200) q(i) ON q.i <= n.c),
      mt AS (SELECT audit_id, arg_min(i, (abs(i - reply), i)) AS k FROM s JOIN n USING (audit_id) WHERE wrong = 0 GROUP BY 1),
      j AS (SELECT n.*, mt.k, s.wrong, s.far, CASE WHEN audit_id % 11 = 0 THEN 'no_book' WHEN n.c > 25 THEN 'overflow' WHEN audit_id % 13 = 0 THEN 'stale' END AS fault
        FROM n LEFT JOIN mt USING (audit_id) JOIN s ON s.audit_id = n.audit_id AND s.i = n.reply)
      SELECT audit_id, CASE WHEN fault IS NOT NULL THEN 'undecidable' WHEN k IS NULL THEN 'inconsistent' WHEN k = reply THEN 'exact' ELSE 'consistent' END AS outcome,
        c AS window_events, CASE WHEN fault IS NULL THEN k END AS match_index, 20 AS levels_rest, CASE WHEN fault IS NULL THEN 20 END AS levels_local,
        CASE WHEN fault IS NULL THEN wrong END AS mismatched_levels, CAST(CASE WHEN fault IS NULL THEN coalesce(far, 0) END AS BIGINT) AS max_abs_diff_e2, fault FROM j""",
    "audits_from_archive": f"""{_FULL.replace(FEED_SQL, _CALM)},
      h AS (SELECT ticker, n, wall - {EPOCH_2024_NS} AS m, stale, kind = 'S' OR now_count IS NOT NULL AS applied,
        list_sort(list_filter(map_entries(lv), lambda x: x.value > 0)) AS book FROM f WHERE n > 0),
      au AS (SELECT event_id AS audit_id, ticker, recv_mono_ns + (event_id % 7 - 3) * {_STEP} AS reply,
        list_sort(list_concat(CASE WHEN event_id % 13 = 0 THEN [] ELSE list_transform(range(10), lambda k: {{'key': CAST(-(5100 + 100*k) AS INTEGER), 'value': 100000 + size_e2}}) END,
          list_transform(range(10), lambda k: {{'key': CAST(4000 + 100*k AS INTEGER), 'value': 100000 + size_e2 + CASE WHEN k = 0 AND event_id % 11 = 0 THEN 1 ELSE 0 END}}))) AS rest
        FROM feed WHERE kind = 'S'),
      o AS (SELECT audit_id, max(n) AS n0, arg_max(stale, n) AS was_stale, arg_max(book, n) AS book FROM au JOIN h ON h.ticker = au.ticker AND h.m < au.reply - {_HALF} GROUP BY 1),
      w AS (SELECT audit_id, n, m, h.stale, applied, h.book, reply, sum(CAST(applied AS INTEGER)) OVER (PARTITION BY audit_id ORDER BY n) AS i
        FROM au JOIN h ON h.ticker = au.ticker AND h.m BETWEEN au.reply - {_HALF} AND au.reply + {_HALF}),
      c AS (SELECT audit_id, min(n) FILTER (stale) AS bad, max(i) AS all_events, count(*) FILTER (applied AND m <= reply) AS ri FROM w GROUP BY 1),
      p AS (SELECT audit_id, max(w.i) AS seen FROM w JOIN c USING (audit_id) WHERE c.bad IS NULL OR w.n <= c.bad GROUP BY 1),
      j AS (SELECT au.audit_id, au.ticker, au.rest, coalesce(c.ri, 0) AS ri, CAST(coalesce(seen, 0) AS BIGINT) AS seen,
        CASE WHEN coalesce(o.was_stale, TRUE) THEN 'no_book' WHEN coalesce(seen, 0) > {_MOST} THEN 'overflow' WHEN c.bad IS NOT NULL THEN 'stale' END AS fault
        FROM au LEFT JOIN o USING (audit_id) LEFT JOIN c USING (audit_id) LEFT JOIN p USING (audit_id)),
      s AS (SELECT audit_id, 0 AS i, book FROM o UNION ALL SELECT audit_id, i, book FROM w WHERE applied),
      mt AS (SELECT s.audit_id, arg_min(s.i, (abs(s.i - j.ri), s.i)) AS k FROM s JOIN j ON j.audit_id = s.audit_id AND s.book = j.rest WHERE j.fault IS NULL GROUP BY 1),
      lv2 AS (SELECT j.audit_id, unnest(s.book) AS x, 1 AS mine FROM j JOIN s ON s.audit_id = j.audit_id AND s.i = j.ri WHERE fault IS NULL
        UNION ALL SELECT audit_id, unnest(rest), 0 FROM j WHERE fault IS NULL),
      df AS (SELECT audit_id, x.key AS k, sum(x.value) FILTER (mine = 1) AS a, sum(x.value) FILTER (mine = 0) AS b FROM lv2 GROUP BY 1, 2),
      dd AS (SELECT audit_id, count(a) AS l, count(*) FILTER (coalesce(a, 0) <> coalesce(b, 0)) AS off, max(abs(coalesce(a, 0) - coalesce(b, 0))) AS far FROM df GROUP BY 1)
      SELECT audit_id, ticker, CASE WHEN fault IS NOT NULL THEN 'undecidable' WHEN k IS NULL THEN 'inconsistent' WHEN k = ri THEN 'exact' ELSE 'consistent' END AS outcome,
        CASE WHEN fault = 'no_book' THEN 0 ELSE least(seen, {_MOST}) END AS window_events, k AS match_index, len(rest) AS levels_rest,
        CASE WHEN fault IS NULL THEN coalesce(l, 0) END AS levels_local, CASE WHEN fault IS NULL THEN coalesce(off, 0) END AS mismatched_levels,
        CASE WHEN fault IS NULL THEN CAST(coalesce(far, 0) AS BIGINT) END AS max_abs_diff_e2, fault
      FROM j LEFT JOIN mt USING (audit_id) LEFT JOIN dd USING (audit_id)""",
    "rest_books": f"""WITH {FEED_SQL} SELECT event_id AS audit_id, CAST(s AS TINYINT) AS side, CASE WHEN s = 0 THEN 4000 + 100*k ELSE 10000 - (4500 + 100*k) END AS price_e4, size_e2 AS count_e2
      FROM feed, range(2) a(s), range(3) b(k) WHERE kind = 'S' AND event_id % 20 <> 0 AND size_e2 <> 0""",
    "level_texts": BOOK_ORACLE["books_at"],
    "catalog_books": BOOK_ORACLE["replay_from_keyframe"].replace("LEFT JOIN top USING (ticker)", "LEFT JOIN top USING (ticker) WHERE e.ticker IN (SELECT ticker FROM h_end) OR e.steps > 0"),
    "stored_range": f"""WITH {FEED_SQL} SELECT ticker, event_id AS seq, price_e4, delta_e2 FROM feed WHERE kind = 'D'
      AND recv_mono_ns // 60 >= 10800000000000 AND recv_mono_ns // 60 < 21600000000000""",
    "stored_trades": f"WITH {FEED_SQL}, {TRADES_SQL} SELECT ticker, trade_id, price_e4 FROM trades WHERE ticker IN (SELECT ticker FROM feed WHERE user_id % 2 = 0)",
    "stored_keyframe": BOOK_ORACLE["keyframe_rows"].replace(f"{shared.MIDDLE_NS} AS as_of_recv_ns, e.ts AS last_ts_ms, e.stale", "e.stale"),
    "prune_decisions": f"""WITH {_INV}, st AS (SELECT inv.dt, inv.hour, CASE WHEN k % 50 <> 1 AND k % 70 = 3 THEN 3 WHEN k % 50 <> 1 AND k % 60 = 2 THEN 4 WHEN k % 50 <> 1 AND k % 40 = 4 THEN 9
        WHEN k % 50 <> 1 AND k % 130 = 5 THEN 4 WHEN k % 50 = 1 AND k % 100 <> 1 AND k % 70 <> 3 THEN 5 END AS r FROM inv JOIN per USING (dt, hour) WHERE f % 13 <> 0),
      rs AS (SELECT dt, hour, 0 AS r FROM per WHERE epoch_us(strptime(concat(dt, 'T', hour), '%Y-%m-%dT%H')) * 1000 + 25 * 3600000000000 >= {RETENTION_NOW}
        UNION ALL SELECT dt, hour, 1 FROM per WHERE f % 13 = 0 UNION ALL SELECT dt, hour, 2 FROM per WHERE f % 13 <> 0 AND f % 17 = 0
        UNION ALL SELECT dt, hour, r FROM st WHERE r IS NOT NULL UNION ALL SELECT dt, hour, 6 FROM per WHERE f % 13 <> 0 AND f % 19 = 0
        UNION ALL SELECT dt, hour, 7 FROM per WHERE f % 13 <> 0 AND f % 23 = 0 UNION ALL SELECT dt, hour, 8 FROM per WHERE f % 13 <> 0 AND f % 23 <> 0 AND f % 29 = 0),
      di AS (SELECT DISTINCT dt, hour, r, min(r) OVER (PARTITION BY dt, hour) AS lo FROM rs),
      tx AS (SELECT dt, hour, string_agg(([{', '.join(repr(r) for r in P.PRUNE_REASONS)}])[r + 1], ',' ORDER BY r) AS reasons FROM di WHERE r <> 9 OR lo = 9 GROUP BY 1, 2),
      bx AS (SELECT dt, hour, sum(bytes + CASE WHEN k % 60 = 2 THEN 1 ELSE 0 END) AS b FROM inv WHERE k % 50 <> 1 GROUP BY 1, 2)
      SELECT per.dt, per.hour, reasons IS NULL AS prunable, coalesce(reasons, '') AS reasons, CASE WHEN reasons IS NULL THEN CAST(coalesce(b, 0) AS BIGINT) ELSE 0 END AS bytes_freed
      FROM per LEFT JOIN tx USING (dt, hour) LEFT JOIN bx USING (dt, hour)""",
    "hours_to_bake": f"""WITH {_INV}, d AS (SELECT dt, hour, bool_or(k % 50 = 1 OR k % 60 = 2) AS differs, bool_or(k % 50 <> 1) AS here FROM inv GROUP BY 1, 2)
      SELECT dt, hour, why FROM (SELECT dt, hour, CASE WHEN f % 13 = 0 THEN CASE WHEN here THEN 'never_baked' END WHEN f % 17 = 0 THEN 'version_stale'
        WHEN f % 23 = 0 THEN 'part_missing' WHEN differs THEN 'segments_differ' END AS why FROM per JOIN d USING (dt, hour) WHERE f % 31 <> 0) WHERE why IS NOT NULL""",
    "table_totals": """SELECT strftime(l_shipdate, '%Y-%m-%d') AS dt, l_orderkey % 24 AS hour, CASE WHEN l_linenumber % 2 = 0 THEN 'deltas' ELSE 'trades' END AS "table",
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS rows, count(*) AS files, CAST(sum(l_partkey) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2, 3""",
    "pruned_once": f"WITH {_INV} SELECT concat(dt, '/', hour, '/s', k, '.zst') AS path, bytes, CASE WHEN k % 2 = 0 THEN 100 ELSE 200 END AS pruned_wall_ns FROM inv WHERE k % 2 = 0 OR k % 3 = 0",
    "replaced_hours": f"WITH {_INV} SELECT dt, hour, CASE WHEN min(k) % 2 = 0 THEN -1 ELSE CAST(sum(bytes) AS BIGINT) END AS bytes FROM inv GROUP BY 1, 2",
}
