"""Interpret raw records: every record becomes exactly one of baked, not baked or a failure.

All JSON is read once with explicit schemas; a record's rows are produced only when all of it
decoded. The stored tables are filters on the classified records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata import schemas
from bookstrata.functions.clock import segment_hour
from bookstrata.functions.exact import (
    COUNT_TEXT,
    PRICE_TEXT,
    complement,
    parse_count,
    parse_price,
    parse_signed_count,
)

# Frame types that become rows, and types counted but not stored.
BAKED_TYPES = (
    "orderbook_delta", "orderbook_snapshot", "trade", "market_lifecycle_v2", "event_lifecycle",
    "event_fee_update",
)
NOT_BAKED_TYPES = ("subscribed", "ok", "unsubscribed", "error", "ticker")
# Which time field an ended market's lifecycle event carries.
END_TIME_FIELDS = {"settled": "settled_ts", "determined": "determination_ts"}
# Outcomes an audit record may have.
AUDIT_OUTCOMES = ("exact", "consistent", "inconsistent", "undecidable")
STOPPED = "stopped"
FAILURE_SAMPLES = 5

_BAD = "_bad"
# Fixed layouts: the fields of recorded frames, gaps, connection events, commands and audits.
_MSG = (
    "market_ticker STRING, price_dollars STRING, delta_fp STRING, side STRING, "
    "client_order_id STRING, ts_ms BIGINT, yes_dollars_fp ARRAY<ARRAY<STRING>>, "
    "no_dollars_fp ARRAY<ARRAY<STRING>>, trade_id STRING, yes_price_dollars STRING, "
    "no_price_dollars STRING, count_fp STRING, taker_book_side STRING, is_block_trade BOOLEAN, "
    "event_type STRING, settled_ts BIGINT, determination_ts BIGINT, close_ts BIGINT, "
    "event_ticker STRING, channel STRING, sid INT, yes_bid_dollars STRING, "
    "yes_ask_dollars STRING, yes_bid_size_fp STRING, yes_ask_size_fp STRING, volume_fp STRING, "
    "open_interest_fp STRING"
)
FRAME = f"type STRING, sid INT, seq BIGINT, id BIGINT, msg STRUCT<{_MSG}>"
GAP = "sid INT, expected_seq BIGINT, got_seq BIGINT"
CONNECTION = "event STRING, detail STRING, dropped BIGINT, wall_ns_delta BIGINT, mono_ns_delta BIGINT"
COMMAND = (
    "cmd STRING, id BIGINT, params STRUCT<sid: INT, sids: ARRAY<INT>, action: STRING, "
    "market_tickers: ARRAY<STRING>>"
)
AUDIT = (
    "ticker STRING, outcome STRING, levels_rest INT, send_mono_ns BIGINT, send_wall_ns BIGINT, "
    "window_open_mono_ns BIGINT, window_close_mono_ns BIGINT, window_events INT, "
    "levels_local INT, mismatched_levels INT, max_abs_diff_e2 BIGINT, match_index INT, "
    "fault STRING, rest_levels STRING, local_levels STRING"
)


def _parse(text: Column, schema: str) -> Column:
    """Read JSON leniently but note anything that did not fit in ``_bad``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    return F.from_json(text, f"{schema}, {_BAD} STRING", options)


def _present(*columns: Column) -> Column:
    ok = F.lit(True)
    for column in columns:
        ok = ok & column.isNotNull()
    return ok


def _raw_levels(pairs: Column, to_yes: Column | bool) -> Column:
    flip = F.lit(to_yes) if isinstance(to_yes, bool) else to_yes

    def level(pair: Column) -> Column:
        price = parse_price(pair[0])
        return F.struct(
            F.when(flip, complement(price)).otherwise(price).cast("int").alias("price_e4"),
            parse_count(pair[1]).alias("count_e2"),
        )

    return F.transform(F.coalesce(pairs, F.array().cast("array<array<string>>")), level)


def _levels_ok(pairs: Column) -> Column:
    # Patterns decide; a count of up to 16 digits fits a BIGINT in hundredths.
    good = F.forall(
        pairs,
        lambda p: (F.size(p) == 2)
        & F.get(p, F.lit(0)).rlike(PRICE_TEXT)
        & F.get(p, F.lit(1)).rlike(COUNT_TEXT)
        & (F.length(F.get(p, F.lit(1))) <= 19),
    )
    return F.coalesce(good, pairs.isNull())


def split_envelopes(records: DataFrame) -> DataFrame:
    """Records with their payload read as JSON: ``frame``, ``gap``, ``conn``, ``cmd``, ``audit``."""
    kind = F.col("kind")
    text = F.col("payload").cast("string")
    return records.select(
        "*",
        segment_hour("segment").alias("hour_label"),
        F.when(kind == 1, _parse(text, FRAME)).alias("frame"),
        F.when(kind == 3, _parse(text, GAP)).alias("gap"),
        F.when(kind == 4, _parse(text, CONNECTION)).alias("conn"),
        F.when(kind == 2, _parse(text, COMMAND)).alias("cmd"),
        F.when(kind == 5, _parse(text, AUDIT)).alias("audit"),
    )


def _frame_ok() -> Column:
    """Whether a frame of a known type has everything its rows need."""
    m = F.col("frame.msg")
    sid = F.col("frame.sid").isNotNull()
    book = sid & m["market_ticker"].isNotNull()
    delta = (
        book
        & m["price_dollars"].rlike(PRICE_TEXT)
        & parse_signed_count(m["delta_fp"]).isNotNull()
        & F.coalesce(m["side"].isin("yes", "no"), F.lit(False))
    )
    image = book & _levels_ok(m["yes_dollars_fp"]) & _levels_ok(m["no_dollars_fp"])
    trade = (
        book
        & _present(m["trade_id"], m["no_price_dollars"], m["ts_ms"])
        & m["yes_price_dollars"].rlike(PRICE_TEXT)
        & parse_count(m["count_fp"]).isNotNull()
        & F.coalesce(m["taker_book_side"].isin("bid", "ask"), F.lit(False))
    )
    kind = F.col("frame.type")
    return (
        F.when(kind == "orderbook_delta", delta)
        .when(kind == "orderbook_snapshot", image)
        .when(kind == "trade", trade)
        .when(kind == "market_lifecycle_v2", book & m["event_type"].isNotNull())
        .when(kind.isin("event_lifecycle", "event_fee_update"), sid & m["event_ticker"].isNotNull())
        .when(kind == "subscribed", _present(m["channel"], m["sid"]))
        .otherwise(F.lit(True))
    )


def classify(records: DataFrame) -> DataFrame:
    """Give every record its ``outcome`` (baked, not_baked, failure) and ``key``."""
    rows = split_envelopes(records)
    kind, ftype = F.col("kind"), F.col("frame.type")
    bad = lambda part: F.col(part).isNull() | F.col(f"{part}.{_BAD}").isNotNull()
    envelope_bad = F.col("frame").isNull() | ftype.isNull()
    payload_bad = F.col(f"frame.{_BAD}").isNotNull() | ~F.coalesce(_frame_ok(), F.lit(False))
    known = ftype.isin(*BAKED_TYPES, *NOT_BAKED_TYPES)
    checked = ftype.isin(*BAKED_TYPES, "subscribed")
    a = F.col("audit")
    audit_bad = (
        bad("audit")
        | ~F.coalesce(a["outcome"].isin(*AUDIT_OUTCOMES), F.lit(False))
        | ~_present(
            a["ticker"], a["levels_rest"], a["send_mono_ns"], a["send_wall_ns"],
            a["window_open_mono_ns"], a["window_close_mono_ns"], a["window_events"],
        )
    )
    gap_bad = bad("gap") | ~_present(F.col("gap.sid"), F.col("gap.expected_seq"), F.col("gap.got_seq"))
    pair = lambda outcome, key: F.struct(F.lit(outcome).alias("outcome"), key.alias("key"))
    failure = lambda name: pair("failure", F.lit(name))
    verdict = (
        F.when((kind == 1) & envelope_bad, failure("frame_envelope"))
        .when((kind == 1) & ~known, failure("frame_unknown_type"))
        .when((kind == 1) & checked & payload_bad, failure("frame_payload"))
        .when((kind == 1) & ftype.isin(*BAKED_TYPES), pair("baked", ftype))
        .when(kind == 1, pair("not_baked", ftype))
        .when((kind == 2) & (bad("cmd") | F.col("cmd.cmd").isNull()), failure("command_payload"))
        .when(kind == 2, pair("not_baked", F.lit("command")))
        .when((kind == 3) & gap_bad, failure("gap_payload"))
        .when(kind == 3, pair("baked", F.lit("gap")))
        .when((kind == 4) & (bad("conn") | F.col("conn.event").isNull()), failure("connection_payload"))
        .when(kind == 4, pair("not_baked", F.lit("connection")))
        .when(audit_bad, failure("audit_payload"))
        .otherwise(pair("baked", F.lit("audit")))
    )
    return rows.withColumn("v", verdict).select("*", "v.outcome", "v.key").drop("v")


def _baked(classified: DataFrame, key: str) -> DataFrame:
    return classified.where((F.col("outcome") == "baked") & (F.col("key") == key))


_RECEIPT = ["segment", "ordinal", "hour_label"]


def delta_rows(classified: DataFrame) -> DataFrame:
    m = F.col("frame.msg")
    price = parse_price(m["price_dollars"])
    flip = (m["side"] == "no") & ~F.col("use_yes_price")
    return _baked(classified, "orderbook_delta").select(
        m["market_ticker"].alias("ticker"), m["ts_ms"].alias("ts_ms"), "recv_mono_ns",
        "recv_wall_ns", F.col("conn_id").cast("short").alias("conn_id"),
        F.col("frame.sid").alias("sid"), F.col("frame.seq").alias("seq"),
        F.when(m["side"] == "yes", 0).otherwise(1).cast("byte").alias("side"),
        F.when(flip, complement(price)).otherwise(price).cast("int").alias("price_e4"),
        parse_signed_count(m["delta_fp"]).alias("delta_e2"),
        m["client_order_id"].alias("own_client_order_id"), *_RECEIPT,
    )


def image_levels(bids: Column, asks: Column) -> Column:
    """Two level arrays as one array of sided levels; an empty book is one ``side=-1`` marker."""

    def sided(levels: Column, side: int) -> Column:
        resting = F.filter(levels, lambda v: v["count_e2"] != 0)
        return F.transform(
            resting,
            lambda v: F.struct(
                F.lit(side).cast("byte").alias("side"), v["price_e4"].alias("price_e4"),
                v["count_e2"].alias("count_e2"),
            ),
        )

    both = F.concat(sided(bids, 0), sided(asks, 1))
    marker = F.array(
        F.struct(
            F.lit(-1).cast("byte").alias("side"), F.lit(0).alias("price_e4"),
            F.lit(0).cast("bigint").alias("count_e2"),
        )
    )
    return F.when(F.size(both) == 0, marker).otherwise(both)


def snapshot_frames(classified: DataFrame) -> DataFrame:
    """One row per stored image, with its ``levels`` array and why it arrived (``reason``)."""
    m = F.col("frame.msg")
    frames = _baked(classified, "orderbook_snapshot").select(
        m["market_ticker"].alias("ticker"), "recv_wall_ns", "recv_mono_ns", "conn_id",
        F.col("frame.sid").alias("sid"), F.col("frame.seq").alias("seq"),
        image_levels(
            _raw_levels(m["yes_dollars_fp"], False),
            _raw_levels(m["no_dollars_fp"], ~F.col("use_yes_price")),
        ).alias("levels"),
        *_RECEIPT,
    )
    return frames.join(_snapshot_reasons(classified, frames), ["segment", "ordinal"])


def _snapshot_reasons(classified: DataFrame, frames: DataFrame) -> DataFrame:
    key = ["segment", "sid", "ticker"]
    asked = (
        classified.where(
            (F.col("outcome") == "not_baked")
            & (F.col("cmd.cmd") == "update_subscription")
            & (F.col("cmd.params.action") == "get_snapshot")
            & F.col("cmd.params.sid").isNotNull()
        )
        .select(
            "segment", F.col("cmd.params.sid").alias("sid"), "ordinal",
            F.explode("cmd.params.market_tickers").alias("ticker"),
        )
        .groupBy(*key)
        .agg(F.min("ordinal").alias("asked_at"))
    )
    openings = segment_openings(classified).select("segment", "opens", "after_lost")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    return (
        frames.select(*key, "ordinal")
        .withColumn("nth", nth)
        .join(asked, key, "left")
        .join(openings, "segment", "left")
        .select(
            "segment",
            "ordinal",
            F.when((F.col("nth") > 1) | F.coalesce(F.col("asked_at") < F.col("ordinal"), F.lit(False)), 1)
            .when(F.col("opens") & F.col("after_lost"), 2)
            .otherwise(0)
            .cast("byte")
            .alias("reason"),
        )
    )


def segment_openings(classified: DataFrame) -> DataFrame:
    """Per segment: whether it opens a connection, and whether the connection before it was lost."""
    event = F.col("conn.event")
    good = (F.col("kind") == 4) & (F.col("outcome") == "not_baked")
    life = good & event.isin("open", "close", "error")
    per = classified.groupBy("hour_label", "segment").agg(
        F.min_by(F.when(good, event), "ordinal").alias("first_event"),
        F.max_by("conn_id", "ordinal").alias("conn_id"),
        F.max_by(event, F.when(life, F.col("ordinal"))).alias("last_event"),
        F.max_by("conn.detail", F.when(life, F.col("ordinal"))).alias("last_detail"),
    )
    lost = (F.col("last_event") == "close") & ~F.col("last_detail").eqNullSafe(F.lit(STOPPED))
    per = per.withColumn("lost", F.coalesce(lost, F.lit(False)))
    # One row per segment; an hour holds one segment per connection attempt.
    before = Window.partitionBy("hour_label", "conn_id").orderBy("segment")
    return per.select(
        "hour_label", "segment", "conn_id",
        F.coalesce(F.col("first_event").isin("open", "error"), F.lit(False)).alias("opens"),
        F.coalesce(F.lag("lost").over(before), F.lit(False)).alias("after_lost"), "lost",
    )


def snapshot_rows(classified: DataFrame) -> DataFrame:
    return snapshot_frames(classified).select(
        "ticker", "recv_wall_ns", "recv_mono_ns", F.col("conn_id").cast("short").alias("conn_id"),
        "sid", "seq", F.inline("levels"), "reason", *_RECEIPT,
    ).select(
        "ticker", "recv_wall_ns", "recv_mono_ns", "conn_id", "sid", "seq", "side", "price_e4",
        "count_e2", "reason", *_RECEIPT,
    )


def trade_rows(classified: DataFrame) -> DataFrame:
    m = F.col("frame.msg")
    return _baked(classified, "trade").select(
        m["market_ticker"].alias("ticker"), m["trade_id"].alias("trade_id"),
        m["ts_ms"].alias("ts_ms"), "recv_wall_ns", F.col("frame.sid").alias("sid"),
        F.col("frame.seq").alias("seq"), parse_price(m["yes_price_dollars"]).alias("price_e4"),
        parse_count(m["count_fp"]).alias("count_e2"),
        F.when(m["taker_book_side"] == "bid", 0).otherwise(1).cast("byte").alias("taker_side"),
        F.coalesce(m["is_block_trade"], F.lit(False)).alias("is_block"), *_RECEIPT,
    )


def ticker_rows(classified: DataFrame) -> DataFrame:
    """Live ticker updates: absent prices stay NULL, absent volume and interest become zero."""
    m = F.col("frame.msg")
    zero = F.lit(0).cast("bigint")
    rows = classified.where((F.col("outcome") == "not_baked") & (F.col("key") == "ticker"))
    return rows.select(
        m["market_ticker"].alias("ticker"), m["ts_ms"].alias("ts_ms"), "conn_id",
        "recv_mono_ns", "recv_wall_ns", F.col("frame.sid").alias("sid"),
        parse_price(m["price_dollars"]).alias("last_e4"),
        parse_price(m["yes_bid_dollars"]).alias("bid_e4"),
        parse_price(m["yes_ask_dollars"]).alias("ask_e4"),
        parse_count(m["yes_bid_size_fp"]).alias("bid_size_e2"),
        parse_count(m["yes_ask_size_fp"]).alias("ask_size_e2"),
        F.coalesce(parse_count(m["volume_fp"]), zero).alias("volume_e2"),
        F.coalesce(parse_count(m["open_interest_fp"]), zero).alias("open_interest_e2"),
    )


def lifecycle_rows(classified: DataFrame) -> DataFrame:
    m = F.col("frame.msg")
    market = F.col("key") == "market_lifecycle_v2"
    ended = F.lit(None).cast("bigint")
    for event, field in END_TIME_FIELDS.items():
        ended = F.when(m["event_type"] == event, m[field]).otherwise(ended)
    keys = ("market_lifecycle_v2", "event_lifecycle", "event_fee_update")
    rows = classified.where((F.col("outcome") == "baked") & F.col("key").isin(*keys))
    return rows.select(
        F.when(market, m["market_ticker"]).otherwise(m["event_ticker"]).alias("ticker"),
        F.col("key").alias("msg_type"), F.when(market, m["event_type"]).alias("event_type"),
        F.when(market, ended).alias("ts_s"), "recv_wall_ns", F.col("frame.sid").alias("sid"),
        F.col("frame.seq").alias("seq"), F.col("msg_text").alias("payload_json"),
        F.when(market, m["close_ts"]).alias("close_ts"), *_RECEIPT,
    )


def audit_rows(classified: DataFrame) -> DataFrame:
    a = F.col("audit")
    return _baked(classified, "audit").select(
        a["ticker"].alias("ticker"), "recv_wall_ns", F.col("conn_id").cast("short").alias("conn_id"),
        a["outcome"].alias("outcome"), a["send_wall_ns"].alias("send_wall_ns"),
        a["send_mono_ns"].alias("send_mono_ns"), "recv_mono_ns",
        a["window_open_mono_ns"].alias("window_open_mono_ns"),
        a["window_close_mono_ns"].alias("window_close_mono_ns"),
        a["window_events"].alias("window_events"), a["match_index"].alias("match_index"),
        a["levels_rest"].alias("levels_rest"), a["levels_local"].alias("levels_local"),
        a["mismatched_levels"].alias("mismatched_levels"),
        a["max_abs_diff_e2"].alias("max_abs_diff_e2"), a["fault"].alias("fault"),
        a["rest_levels"].alias("rest_levels_json"), a["local_levels"].alias("local_levels_json"),
        *_RECEIPT,
    )


def stored(rows: DataFrame, table: str) -> DataFrame:
    """Only the stored columns of a table, with its stored types, plus ``hour_label``."""
    schema = schemas.TABLES[table].schema
    extra = ["hour_label"] if "hour_label" in rows.columns else []
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*kept, *extra)


def accounting(classified: DataFrame) -> DataFrame:
    """Records per hour, kind, outcome and key."""
    return classified.groupBy("hour_label", "kind", "outcome", "key").agg(
        F.count(F.lit(1)).alias("records")
    )


def accounting_check(account: DataFrame, facts: DataFrame) -> DataFrame:
    """Hours whose accounted records differ from the records read; empty when all is well."""
    accounted = account.groupBy("hour_label").agg(F.sum("records").alias("accounted"))
    read = facts.groupBy("hour_label").agg(F.sum("records").alias("read"))
    zero = F.lit(0)
    joined = accounted.join(read, "hour_label", "full").select(
        "hour_label", F.coalesce("accounted", zero).alias("accounted"),
        F.coalesce("read", zero).alias("read"),
    )
    return joined.where(F.col("accounted") != F.col("read"))


def failure_samples(classified: DataFrame, n: int = FAILURE_SAMPLES) -> DataFrame:
    """The first ``n`` failures of each class per hour, in record order.

    The rank filter is applied before the shuffle as well, so a class holding most records still
    sends only ``n`` rows per task.
    """
    order = Window.partitionBy("hour_label", "key").orderBy("segment", "ordinal")
    failed = classified.where(F.col("outcome") == "failure")
    ranked = failed.select("hour_label", "key", "segment", "ordinal", F.col("payload").cast("string").alias("text"))
    return ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
