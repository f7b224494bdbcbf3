import datetime as dt
import re
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookstrata.functions import clock as C
from bookstrata.functions import exact as E
from bookstrata.functions import grid as G
from bookstrata.functions import levels as L


def scaled(text, places, low=None, high=None):
    if not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text):
        return None
    value = Decimal(text).scaleb(places)
    if value != value.to_integral_value():
        return None
    value = int(value)
    if (low is not None and value < low) or (high is not None and value > high):
        return None
    return value


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(
    st.from_regex(r"\A-?[0-9]{1,3}(\.[0-9]{1,7})?\Z"), st.from_regex(r"\A-?0*[01](\.[0-9]{1,4}0{0,3})?\Z"),
    st.text(alphabet="0123456789.-+e x\n", max_size=8)), min_size=200, max_size=400))
def test_parsing_is_exact(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", E.parse_price("t"), E.parse_count("t"), E.parse_signed_count("t"), E.parse_dollars("t")).collect()
    for t, price, count, signed, dollars in rows:
        assert price == scaled(t, 4, 0, 10_000), t
        assert count == scaled(t, 2, 0), t
        assert signed == scaled(t, 2), t
        assert dollars == scaled(t, 6), t


def test_division_and_formats(spark):
    pairs = [(a, b) for a in (-9, -8, -1, 0, 1, 7, 2**62 + 1) for b in (-4, -3, 1, 3, 5)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for a, b, lo, hi in df.select("a", "b", E.div_floor("a", "b"), E.div_ceil("a", "b")).collect():
        assert lo == a // b and hi == -((-a) // b)
    got = spark.range(1).select(E.format_price(F.lit(-5)), E.format_count(F.lit(1234)), E.format_dollars(F.lit(-1))).first()
    assert tuple(got) == ("-0.0005", "12.34", "-0.000001")


def test_level_hash_matches_the_finalizer(spark):
    def mix(z):
        m = (1 << 64) - 1
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        return z ^ (z >> 31)

    rows = [(s, p, c) for s in (0, 1) for p in (0, 1, 5600, 10_000) for c in (1, 10**6, 2**43)]
    df = spark.createDataFrame(rows, "side int, price int, count bigint")
    got = df.select("*", L.unsigned(L.level_mix64("side", "price", "count")).alias("h")).collect()
    for s, p, c, h in got:
        assert int(h) == mix((s << 63) | (p << 44) | c)
    total = df.select(L.level_mix64("side", "price", "count").alias("h")).agg(L.checksum_of("h")).first()[0]
    assert int(total) == sum(mix((s << 63) | (p << 44) | c) for s, p, c in rows) % 2**64


def test_hours(spark):
    at = [-1, 0, 3_599_999_999_999, 3_600_000_000_000, 1_789_102_800_123_456_789]
    df = spark.createDataFrame([(a,) for a in at], "w bigint")
    for w, label, start in df.select("w", C.hour_label("w"), C.hour_start("w")).collect():
        when = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=w // 1000)
        assert label == when.strftime("%Y-%m-%dT%H") and start == w - w % C.NS_PER_HOUR
    bad = spark.createDataFrame([("2024-02-30T01",), ("2024-01-01T24",), ("x",)], "t string")
    assert all(r[0] is None for r in bad.select(C.parse_hour_label("t")).collect())
    with pytest.raises(ValueError):
        C.check_keyframe_interval(7 * 60)


def test_grid_rows(spark):
    for step, price, row in ((100, 50, 1), (100, 49, 0), (100, 10_000, 100), (10, 5, 1), (2500, 1249, 0)):
        got = spark.range(1).select(G.row_for_price(F.lit(price), F.lit(step), F.lit(10_000 // step + 1))).first()[0]
        assert got == row


def test_compact_contracts_round_their_double(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from bookstrata.functions.display import format_compact_contracts

    counts = [*range(0, 12_000, 10), *range(950_000, 10_300_000, 25_000), 41_000, 10_050_000]
    frame = spark.createDataFrame([(c,) for c in counts], "c long")
    got = [r[0] for r in frame.select(format_compact_contracts(frame.c * 100)).collect()]

    def plain(c):
        unit, sign = (1, "") if c < 1_000 else (1_000, "K") if c < 1_000_000 else (1_000_000, "M")
        if unit == 1 or c >= 10 * unit:
            return f"{c // unit}{sign}"
        # Decimal takes the double's exact value.
        return str(Decimal(c / unit).quantize(Decimal("0.1"), ROUND_HALF_UP)).removesuffix(".0") + sign

    assert got == [plain(c) for c in counts]
    assert got[counts.index(1_150)] == "1.1K" and got[counts.index(1_450)] == "1.4K"


def test_grid_prices_of_one_range_are_not_looked_at_one_by_one(spark):
    kind = "id int, ranges array<struct<start_e4:int,end_e4:int,step_e4:int>>"
    given_ranges = [
        [(0, 10_000, 100)], [(-7, 20_000, 3)], [(10_000, 10_000, 1)], [(0, 0, 3)], [(10_000, 0, -7)], [(5, 5, 0)],
        [(0, 100, 10), (50, 120, 7)], [None], [], None,
    ]
    rows = spark.createDataFrame(list(enumerate(given_ranges)), kind)
    got = {r.id: r.p for r in rows.select("id", G.grid_prices("ranges").alias("p")).collect()}
    for i, ranges in enumerate(given_ranges):
        if ranges is None or None in ranges:
            assert got[i] is None
            continue
        every = {p for a, b, s in ranges for p in range(a, b + (1 if s >= 0 else -1), s or 1)}
        assert got[i] == sorted(p for p in every if 0 < p < 10_000)


def test_a_grid_of_one_range_takes_far_less_than_looking_at_each_price(spark):
    step = (F.col("id") % 1 + 1).cast("int").alias("step_e4")
    wide = spark.range(10_000).select(F.array(F.struct(F.lit(0).alias("start_e4"), F.lit(10_000).alias("end_e4"), step)).alias("r")).coalesce(1)
    ticks = F.flatten(F.transform("r", lambda r: F.sequence(r["start_e4"], r["end_e4"], r["step_e4"])))
    each = F.sort_array(F.array_distinct(F.filter(ticks, lambda p: (p > 0) & (p < 10_000))))
    seconds = []
    for prices in (G.grid_prices("r"), each):
        began = time.perf_counter()
        assert wide.agg(F.sum(F.size(prices))).first()[0] == 10_000 * 9_999
        seconds.append(time.perf_counter() - began)
    assert seconds[0] * 2 < seconds[1]
