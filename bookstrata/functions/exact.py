"""Exact fixed-point arithmetic as Column functions (no floating point anywhere)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal places kept for prices, counts and dollar amounts.
PRICE_DECIMALS = 4
COUNT_DECIMALS = 2
DOLLARS_DECIMALS = 6
PRICE_SCALE = 10_000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _plain(decimals: int, sign: str = "-?") -> str:
    """Pattern of plain decimal text exact at some places; zeros after them change nothing."""
    return rf"{sign}[0-9]+(?:\.[0-9]{{1,{decimals}}}0*)?"


# Text of a value in 0..1 dollar, and text of a count that is not negative.
PRICE_TEXT = rf"\A(?:-?0+(?:\.0+)?|0*1(?:\.0+)?|{_plain(PRICE_DECIMALS, '').replace('[0-9]+', '0+', 1)})\z"
COUNT_TEXT = rf"\A(?:-0+(?:\.0+)?|{_plain(COUNT_DECIMALS, '')})\z"


def _digits(text: Column, decimals: int) -> Column:
    """Plain decimal text with its point moved right and dropped, as BIGINT; NULL on overflow."""
    padded = F.concat(text, F.when(F.instr(text, ".") > 0, "").otherwise("."), F.lit("0" * decimals))
    whole = F.substring_index(padded, ".", 1)
    fraction = F.substring(F.substring_index(padded, ".", -1), 1, decimals)
    return F.concat(whole, fraction).try_cast("bigint")


def parse_scaled(text: Column | str, decimals: int) -> Column:
    """Scale plain decimal text to a BIGINT exactly; NULL when it is not exact.

    A decimal cast alone would round extra digits, so the text must match in full first.
    """
    text = _col(text)
    return F.when(text.rlike(rf"\A{_plain(decimals)}\z"), _digits(text, decimals))


def parse_price(text: Column | str) -> Column:
    """Dollar price text to 1/10,000 dollar, NULL unless it lies in 0..1 dollar."""
    text = _col(text)
    return F.when(text.rlike(PRICE_TEXT), _digits(text, PRICE_DECIMALS).cast("int"))


def parse_count(text: Column | str) -> Column:
    """Contract count text to 1/100 contract, NULL when negative or inexact."""
    text = _col(text)
    return F.when(text.rlike(COUNT_TEXT), _digits(text, COUNT_DECIMALS))


def parse_signed_count(text: Column | str) -> Column:
    """Signed contract change text to 1/100 contract."""
    return parse_scaled(text, COUNT_DECIMALS)


def parse_dollars(text: Column | str) -> Column:
    """Signed dollar text to micro-dollars."""
    return parse_scaled(text, DOLLARS_DECIMALS)


def number_problem(text: Column | str, decimals: int) -> Column:
    """Why text is not an exact number with that many places, or NULL when it is."""
    text = _col(text)
    return (
        F.when(text.isNull(), F.lit("missing"))
        .when(~text.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), F.lit("not a plain decimal"))
        .when(parse_scaled(text, decimals).isNull(), F.lit("too many digits"))
    )


def format_scaled(value: Column | str, decimals: int) -> Column:
    """Canonical decimal text with a fixed number of places."""
    value = _col(value).cast("bigint")
    scale = 10**decimals
    return F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        int_div(F.abs(value), F.lit(scale)).cast("string"),
        F.lit("."),
        F.lpad((F.abs(value) % scale).cast("string"), decimals, "0"),
    )


def format_price(value: Column | str) -> Column:
    return format_scaled(value, PRICE_DECIMALS)


def format_count(value: Column | str) -> Column:
    return format_scaled(value, COUNT_DECIMALS)


def format_dollars(value: Column | str) -> Column:
    return format_scaled(value, DOLLARS_DECIMALS)


def complement(price: Column | str) -> Column:
    """The other leg's price: one dollar less the given price."""
    return F.lit(PRICE_SCALE) - _col(price)


def notional_e6(price: Column | str, count: Column | str) -> Column:
    """Price times count in micro-dollars; exact because the units multiply."""
    return _col(price).cast("bigint") * _col(count).cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Truncating integer division (SQL ``div``) without going through a double."""
    return F.call_function("div", a, b)


def div_floor(a: Column | str, b: Column | str) -> Column:
    """Integer division rounding toward negative infinity, exact for any signs."""
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    quotient = int_div(a, b)
    off = (a % b != 0) & ((a < 0) != (b < 0))
    return quotient - off.cast("bigint")


def div_ceil(a: Column | str, b: Column | str) -> Column:
    """Integer division rounding toward positive infinity, exact for any signs."""
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    quotient = int_div(a, b)
    off = (a % b != 0) & ((a < 0) == (b < 0))
    return quotient + off.cast("bigint")


def floor_to(value: Column | str, step: int) -> Column:
    """Largest multiple of a positive constant at or below a value."""
    value = _col(value).cast("bigint")
    return value - F.pmod(value, F.lit(step))


def floor_div(value: Column | str, step: int) -> Column:
    """Floor division by a positive constant, exact on BIGINT."""
    return int_div(floor_to(value, step), F.lit(step).cast("bigint"))
