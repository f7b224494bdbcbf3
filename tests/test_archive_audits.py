"""Audits judged from an archive beside a plain tap over a sequential book."""

import random

import pytest
from pyspark.sql import functions as F

from bookstrata.operators import archive_audits as A
from bookstrata.operators import replay as R
from tests.sequential import OneBook, in_order
from tests.test_replay import SECOND, make_feed, to_tables
from tests.test_windows import judge

AUDIT = "audit_id int, ticker string, stretch int, window_open_mono_ns bigint, reply_mono_ns bigint, window_close_mono_ns bigint"
LEVEL = "audit_id int, side tinyint, price_e4 int, count_e2 bigint"


def histories(feed):
    """Per market, each step ``(instant, was_stale, change or None, levels after, stale after)``; gaps that stale are steps."""
    books, steps = {}, {}
    for position, (_, _, kind, row) in in_order(feed):
        at = position[:2]
        if kind == "G":
            for ticker, book in books.items():
                if book.sub == (row["conn_id"], row["sid"]) and not book.stale:
                    book.stale = True
                    steps[ticker].append((at, False, None, dict(book.levels), True))
            continue
        book = books.setdefault(row["ticker"], OneBook())
        book.sub = (row["conn_id"], row["sid"])
        was, before = book.stale, dict(book.levels)
        if kind == "D":
            book.delta(row["side"], row["price_e4"], row["delta_e2"], row["ts_ms"])
            applied = not was and not (book.stale and book.levels == before)
            change = ("D", (row["side"], row["price_e4"], row["delta_e2"]))
        else:
            book.image(row["levels"])
            applied = not book.stale
            change = ("S", row["levels"])
        steps.setdefault(row["ticker"], []).append((at, was, change if applied else None, dict(book.levels), book.stale))
    return steps


def tap(steps, boot, opened, closed, most):
    """The opening levels, the changes recorded and the fault."""
    before = [s for s in steps if s[0] < (boot, opened)]
    if not before or before[-1][4]:
        return None, [], "no_book"
    start, stale, events, fault = before[-1][3], False, [], None
    for at, was, change, _, now in steps:
        if not (boot, opened) <= at <= (boot, closed):
            continue
        stale = now
        if change is None or fault:
            continue
        if was:
            fault = "stale"
        elif len(events) >= most:
            fault = "overflow"
        else:
            events.append((at[1], *change))
    return start, events, fault or ("stale" if stale else None)


def plan(feed, seed, most):
    rng = random.Random(seed)
    steps = histories(feed)
    audits, rests, want = [], [], {}
    for a in range(400):
        ticker = rng.choice(sorted(steps))
        calm = [s for s in steps[ticker] if not s[4]]
        boot, mono = rng.choice(calm if calm and rng.random() < 0.9 else steps[ticker])[0]
        wide = rng.choice([60, 300, 900])
        edge = rng.choice([0, 0, 1]) * SECOND
        opened, closed = mono - rng.randrange(0, wide) * SECOND, mono + rng.randrange(0, wide) * SECOND
        reply = min(closed, max(opened, mono + rng.randrange(-200, 200) * SECOND))
        if edge:
            opened, reply, closed = mono, mono, rng.choice(steps[ticker])[0][1]
            closed = max(closed, opened) if closed - opened < 2_000 * SECOND else opened
        start, events, fault = tap(steps[ticker], boot, opened, closed, most)
        near = [s for s in steps[ticker] if s[0][0] == boot and abs(s[0][1] - reply) < 600 * SECOND]
        rest = dict(rng.choice(near)[3]) if near else {}
        if rest and rng.random() < 0.15:
            level = rng.choice(sorted(rest))
            rest[level] += 1
        audits.append((a, ticker, boot, opened, reply, closed))
        rests += [(a, s, p, c) for (s, p), c in rest.items()]
        if fault:
            want[a] = ("undecidable", None, len(events), fault, None)
            continue
        outcome, index = judge(start, events, rest, reply)
        held = dict(start)
        for at, kind, payload in events:
            if at > reply:
                break
            if kind == "S":
                held = {(s, p): c for s, p, c in payload}
            else:
                held[payload[:2]] = held.get(payload[:2], 0) + payload[2]
        held = {k: v for k, v in held.items() if v}
        off = sum(held.get(k, 0) != rest.get(k, 0) for k in held.keys() | rest.keys())
        want[a] = (outcome, index, len(events), None, off)
    return audits, rests, want


def verdicts(spark, line, audits, rests, most, **options):
    out = A.audits_from_archive(line, spark.createDataFrame(audits, AUDIT), spark.createDataFrame(rests, LEVEL), most, **options)
    return {r.audit_id: (r.outcome, r.match_index, r.window_events, r.fault, r.mismatched_levels) for r in out.collect()}


@pytest.mark.parametrize("seed,calm,restart,slice_rows,most", [(31, True, False, 4096, 40), (32, True, True, 16, 8), (33, False, False, 8, 40)])
def test_archive_audits_equal_a_tap(spark, seed, calm, restart, slice_rows, most):
    feed = make_feed(seed, tickers=4, calm=calm, restart=restart)
    audits, rests, want = plan(feed, seed, most)
    assert len({w[0] for w in want.values()}) == 4 and sum(w[3] is None for w in want.values()) > 50
    assert {w[3] for w in want.values()} >= {None, "no_book", "stale"}
    line = R.timeline(*to_tables(spark, feed), slice_rows=slice_rows)
    assert verdicts(spark, line, audits, rests, most) == want


def test_colliding_fingerprints_are_no_match(spark):
    """With useless hashes, states are told apart by their levels all the same: a wrong hit is never a match."""
    feed = make_feed(34, tickers=4, calm=True)
    audits, rests, want = plan(feed, 34, 40)
    line = R.timeline(*to_tables(spark, feed), slice_rows=64)
    got = verdicts(spark, line, audits, rests, 40, hashes=lambda side, price, count: [F.lit(0).cast("bigint")])
    assert any(g[3] == "collision" for g in got.values())
    for a, g in got.items():
        assert g[3] == "collision" or g == want[a] or (g[0], want[a][0]) == ("consistent", "consistent")


def test_odd_audits(spark):
    """NULL fields, unknown markets and an empty snapshot; no audits and no snapshots at all."""
    levels = [(0, 4000, 5), (1, 5000, 5)]
    base = {"ticker": "M", "conn_id": 0, "sid": 1}
    feed = [(10**18 + n * SECOND, n * SECOND, "S", {**base, "seq": n, "levels": levels if n % 2 else []}) for n in range(1, 5)]
    line = R.timeline(*to_tables(spark, feed))
    s = SECOND
    audits = [(1, "M", 0, 2 * s, 2 * s, 4 * s), (2, None, 0, 2 * s, 2 * s, 4 * s), (3, "N", 0, 2 * s, 2 * s, 4 * s), (4, "M", 0, None, 2 * s, 4 * s), (5, "M", 0, s, s, 2 * s)]
    none = spark.createDataFrame([], LEVEL)
    out = {r.audit_id: (r.outcome, r.match_index, r.fault) for r in A.audits_from_archive(line, spark.createDataFrame(audits, AUDIT), none).collect()}
    lost = ("undecidable", None, "no_book")
    assert out == {1: ("exact", 1, None), 2: lost, 3: lost, 4: lost, 5: lost}
    assert A.audits_from_archive(line, spark.createDataFrame([], AUDIT), none).count() == 0
