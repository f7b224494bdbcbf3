"""Time units, hour keys and path-derived facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookstrata.functions.exact import _col, floor_div, floor_to

NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000
NS_PER_MINUTE = 60 * NS_PER_S
NS_PER_HOUR = 3_600 * NS_PER_S
NS_PER_DAY = 24 * NS_PER_HOUR
SECONDS_PER_DAY = 86_400

# Fixed value: a monotonic reading this far below an earlier one means the host restarted.
RESTART_DROP_NS = 600 * NS_PER_S
# Fixed value: a row may be stored one hour after the hour it was received in.
WRITE_LAG_HOURS = 1
# Fixed value: wall time may outrun monotonic time by this much before it counts as a sleep.
CLOCK_JUMP_NS = 5 * NS_PER_S


def ms_to_ns(value: Column | str) -> Column:
    return _col(value).cast("bigint") * NS_PER_MS


def ns_to_ms(value: Column | str) -> Column:
    return floor_div(value, NS_PER_MS)


def s_to_ms(value: Column | str) -> Column:
    return _col(value).cast("bigint") * 1_000


def wall_timestamp(wall_ns: Column | str) -> Column:
    """Display timestamp; truncates nanoseconds to microseconds."""
    return F.timestamp_micros(floor_div(wall_ns, 1_000))


def hour_start(wall_ns: Column | str) -> Column:
    return floor_to(wall_ns, NS_PER_HOUR)


def hour_end(wall_ns: Column | str) -> Column:
    return hour_start(wall_ns) + NS_PER_HOUR


def hour_label(wall_ns: Column | str) -> Column:
    """``YYYY-MM-DDTHH`` of the UTC hour holding an instant."""
    return F.concat(hour_date(wall_ns), F.lit("T"), hour_of_day(wall_ns))


def hour_date(wall_ns: Column | str) -> Column:
    """``YYYY-MM-DD``; independent of the session time zone."""
    return F.date_add(F.lit(dt.date(1970, 1, 1)), floor_div(wall_ns, NS_PER_DAY).cast("int")).cast(
        "string"
    )


def hour_of_day(wall_ns: Column | str) -> Column:
    """Two-digit UTC hour of day."""
    hour = floor_div(F.pmod(_col(wall_ns).cast("bigint"), F.lit(NS_PER_DAY)), NS_PER_HOUR)
    return F.lpad(hour.cast("string"), 2, "0")


def label_hours(label: Column | str) -> Column:
    """The hour a label names, in whole hours since 1970; NULL when it is not a label."""
    label = _col(label)
    day = F.try_to_date(F.substring(label, 1, 10), "yyyy-MM-dd")
    hour = F.substring(label, 12, 2).try_cast("int")
    good = label.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}\z") & hour.between(0, 23)
    days = F.datediff(day, F.lit(dt.date(1970, 1, 1))).cast("bigint")
    return F.when(good, days * 24 + hour.cast("bigint"))


def parse_hour_label(label: Column | str) -> Column:
    """Start of the hour a label names, in wall nanoseconds; NULL when it is not a label.

    It is NULL, too, for hours that BIGINT nanoseconds cannot hold, those from 2262-04-12T00 on.
    """
    return F.try_multiply(label_hours(label), F.lit(NS_PER_HOUR))


def check_keyframe_interval(interval_s: int) -> None:
    """Reject an interval that does not put keyframes on the same minutes of every hour."""
    if interval_s <= 0 or interval_s % 60 or 3_600 % interval_s:
        raise ValueError(f"a keyframe interval must be whole minutes dividing an hour: {interval_s}")


def keyframe_slot(wall_ns: Column | str, interval_s: int) -> Column:
    """Start of the keyframe slot an instant falls in."""
    check_keyframe_interval(interval_s)
    return floor_to(wall_ns, interval_s * NS_PER_S)


def is_clock_jump(wall_delta: Column, mono_delta: Column, threshold_ns: int = CLOCK_JUMP_NS) -> Column:
    """Whether wall time outran monotonic time by more than a threshold."""
    return (wall_delta - mono_delta) > F.lit(threshold_ns)


# Fixed pattern: a segment's name relative to the raw folder starts with its day and hour.
SEGMENT_NAME = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})/([0-9]{2})/[A-Za-z0-9._-]+\z"
# Fixed pattern: characters allowed in a market ticker.
TICKER_NAME = r"\A[A-Z0-9][A-Z0-9.-]*\z"


def segment_hour(name: Column | str) -> Column:
    """``YYYY-MM-DDTHH`` a segment's name places it in; NULL for another shape."""
    name = _col(name)
    label = F.concat(
        F.regexp_extract(name, SEGMENT_NAME, 1), F.lit("T"), F.regexp_extract(name, SEGMENT_NAME, 2)
    )
    return F.when(name.rlike(SEGMENT_NAME) & label_hours(label).isNotNull(), label)


def is_ticker(name: Column | str) -> Column:
    return _col(name).rlike(TICKER_NAME)


def is_closed_hour(hour_start_ns: Column | str, now_ns: int, grace_ns: int) -> Column:
    """Whether an hour ended strictly more than a grace period ago."""
    if grace_ns < 0:
        raise ValueError("grace_ns must be non-negative")
    return _col(hour_start_ns) + F.lit(NS_PER_HOUR + grace_ns) < F.lit(now_ns)
