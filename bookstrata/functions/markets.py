"""Scalar rules about listed markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookstrata.functions.exact import PRICE_SCALE, _col, floor_div, parse_price

# Statuses, strike types and lifecycle events that carry meaning.
ACTIVE_STATUS = "active"
THRESHOLD_STRIKES = ("greater", "greater_or_equal", "less", "less_or_equal")
ENDED_EVENTS = ("determined", "settled")
MOVED_EVENT = "close_date_updated"


def series_of(ticker: Column | str) -> Column:
    """Text before a ticker's first dash; a ticker without one is its own series."""
    return F.substring_index(_col(ticker), "-", 1)


def parse_close_ts(text: Column | str) -> Column:
    """ISO-8601 close time to Unix seconds; empty and year 1 mean unknown. Naive means UTC."""
    text = _col(text)
    moment = F.try_to_timestamp(text)
    seconds = floor_div(F.unix_micros(moment), 1_000_000)
    return F.when((text == "") | (F.year(moment) == 1), F.lit(None)).otherwise(seconds)


def close_ts_problem(text: Column | str) -> Column:
    """Why a close time does not parse, or NULL."""
    text = _col(text)
    bad = text.isNull() | ((text != "") & F.try_to_timestamp(text).isNull())
    return F.when(bad, F.lit("unparsable close_time"))


def parse_quote(text: Column | str, absent: int) -> Column:
    """A listed price; empty text and the placeholder for "no price" become NULL."""
    return F.nullif(parse_price(text), F.lit(absent))


def quote_problem(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.isNull() | ((text != "") & parse_price(text).isNull()), F.lit("bad price"))


def yes_mid(bid: Column | str, ask: Column | str, last: Column | str) -> Column:
    """Floored middle of bid and ask when both exist, else the last price."""
    bid, ask = _col(bid), _col(ask)
    middle = floor_div(bid + ask, 2).cast("int")
    return F.when(bid.isNotNull() & ask.isNotNull(), middle).otherwise(_col(last))


def is_open(close_ts: Column, ended: Column, now_ts: int) -> Column:
    """Whether a market is neither ended nor past its close; an unknown close stays open."""
    return ~F.coalesce(ended, F.lit(False)) & (close_ts.isNull() | (close_ts > F.lit(now_ts)))


def last_close_ms(close_ts: Column | str, now_ms: int) -> Column:
    """Aggregate: the latest close at or before an instant."""
    close_ms = _col(close_ts).cast("bigint") * 1_000
    return F.max(F.when(close_ms <= now_ms, close_ms))


def ms_until_next_close(close_ts: Column | str, now_ms: int) -> Column:
    """Aggregate: the smallest positive delay to a close."""
    delay = _col(close_ts).cast("bigint") * 1_000 - F.lit(now_ms)
    return F.min(F.when(delay > 0, delay))


def text_matches(columns: Sequence[Column | str], query: str) -> Column:
    """Case-insensitive contains over several columns; NULL columns never match."""
    if query == "":
        return F.lit(True)
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.lower(_col(column)).contains(query.lower()), F.lit(False))
    return hit


def topic_of(event_type: Column | str, ticker: Column | str) -> Column:
    """The bus topic an event is published on."""
    event_type = _col(event_type)
    return (
        F.when(event_type == "lifecycle", F.lit("ctl.lifecycle"))
        .when(event_type == "gap", F.lit("ctl.gap"))
        .when(event_type == "catalog", F.lit("ctl.catalog"))
        .when(event_type == "status", F.lit("ctl.status"))
        .otherwise(F.concat(F.lit("md."), _col(ticker)))
    )


def book_state(has_book: Column, stale: Column) -> Column:
    """How far a held book can be trusted: unknown, stale or fresh."""
    return (
        F.when(~F.coalesce(has_book, F.lit(False)), F.lit("unknown"))
        .when(stale, F.lit("stale"))
        .otherwise(F.lit("fresh"))
    )


NO_BID = 0
NO_ASK = PRICE_SCALE
