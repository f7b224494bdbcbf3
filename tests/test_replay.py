import random

import pytest
from pyspark.sql import functions as F

from bookstrata import schemas
from bookstrata.operators import replay as R
from bookstrata.operators.ordering import restart_boundaries, with_stretch
from tests.sequential import OneBook, run

SECOND = 1_000_000_000


def make_feed(seed, tickers=12, events=900, calm=False, restart=False):
    rng = random.Random(seed)
    feed, wall, mono = [], 10**18, 5_000_000 * SECOND
    for n in range(events):
        step = rng.randrange(1, 40) * SECOND
        wall += step
        mono += step
        if restart and n == events // 2:
            mono = 7 * SECOND
        ticker = f"M{rng.randrange(tickers) if rng.random() < 0.5 else 0}"
        conn = rng.randrange(2) if rng.random() < 0.05 else int(ticker[1:]) % 2
        base = {"ticker": ticker, "conn_id": conn, "sid": 1, "seq": n}
        roll = rng.random()
        if roll < (0.01 if calm else 0.03):
            feed.append((wall, mono, "G", {"conn_id": rng.randrange(2), "sid": 1, "seq": n}))
        elif roll < (0.06 if calm else 0.12):
            levels = [(0, 4000 + 100 * k, 500) for k in range(rng.randrange(0, 5))]
            levels += [(1, 5100 + 100 * k, 500) for k in range(rng.randrange(0, 5))]
            if rng.random() < 0.1:
                levels.append((0, 6000, 10))
            if rng.random() < 0.1:
                levels.append((1, 7000, 0))
            if rng.random() < 0.05 and levels:
                levels.append(levels[0])
            feed.append((wall, mono, "S", {**base, "levels": levels}))
        else:
            side = rng.randrange(2)
            price = (4000 if side == 0 else 5100) + 100 * rng.randrange(5)
            if rng.random() < (0.004 if calm else 0.02):
                price = 5500 if side == 0 else 4100
            change = rng.choice([100, 200, -100, -200, -500] if not calm else [100, 200, -50, 50])
            ts = None if rng.random() < 0.2 else n
            feed.append(
                (wall, mono, "D", {**base, "side": side, "price_e4": price, "delta_e2": change, "ts_ms": ts})
            )
    return feed


def to_tables(spark, feed):
    deltas, snaps, gaps = [], [], []
    for wall, mono, kind, r in feed:
        if kind == "D":
            deltas.append((r["ticker"], r["ts_ms"], mono, wall, r["conn_id"], 1, r["seq"], r["side"],
                           r["price_e4"], r["delta_e2"], None))
        elif kind == "S":
            for side, price, count in r["levels"] or [(-1, 0, 0)]:
                snaps.append((r["ticker"], wall, mono, r["conn_id"], 1, r["seq"], side, price, count, 0))
        else:
            gaps.append((r["conn_id"], 1, wall, mono, r["seq"], r["seq"] + 1, None))
    return (
        spark.createDataFrame(deltas, schemas.DELTAS),
        spark.createDataFrame(snaps, schemas.SNAPSHOTS),
        spark.createDataFrame(gaps, schemas.GAPS),
    )


def as_dict(books):
    levels = {}
    for r in books.levels.collect():
        levels.setdefault(r.ticker, {})[r.side, r.price_e4] = r.count_e2
    return {r.ticker: (r.stale, r.last_ts_ms, levels.get(r.ticker, {})) for r in books.status.collect()}


@pytest.mark.parametrize(
    "seed,calm,restart,slice_rows",
    [(1, False, False, 4096), (2, True, False, 30), (3, True, True, 16), (4, False, True, 8)],
)
def test_replay_equals_sequential_book(spark, seed, calm, restart, slice_rows):
    feed = make_feed(seed, calm=calm, restart=restart)
    for upto in (len(feed) // 3, len(feed)):
        want = {
            t: (b.stale, b.ts, b.levels) for t, b in run(feed[:upto]).items()
        }
        got = as_dict(R.replay(*to_tables(spark, feed[:upto]), slice_rows=slice_rows))
        assert got == want


def test_keyframe_to_keyframe(spark):
    """Books rebuilt from an earlier full image equal a later one."""
    feed = make_feed(9, calm=True)
    half = len(feed) // 2
    first = run(feed[:half])
    rows = []
    for ticker, book in first.items():
        for side, price, count in [(s, p, c) for (s, p), c in book.levels.items()] or [(-1, 0, 0)]:
            rows.append((ticker, side, price, count, feed[half - 1][0], book.ts, book.stale))
    keyframe = spark.createDataFrame(rows, schemas.KEYFRAMES)
    base = {}
    for ticker, book in first.items():
        fresh = OneBook()
        fresh.levels, fresh.stale, fresh.ts = dict(book.levels), book.stale, book.ts
        if fresh.crossed():
            fresh.stale = True
        base[ticker] = fresh
    want = {t: (b.stale, b.ts, b.levels) for t, b in run(feed[half:], base).items()}
    got = as_dict(R.replay(*to_tables(spark, feed[half:]), keyframe=keyframe, slice_rows=32))
    assert got == want


def test_timeline_ends_and_quotes_match_sequential(spark):
    feed = make_feed(21, calm=True, events=300)
    line = R.timeline(*to_tables(spark, feed), slice_rows=20)
    quotes = {}
    for r in line.top_of_book().collect():
        quotes.setdefault(r.ticker, []).append((r.wall, r.best_bid, r.best_ask))
    seen = {}
    for upto in range(1, len(feed) + 1):
        wall, _, kind, row = feed[upto - 1]
        if kind == "G":
            continue
        book = run(feed[:upto])[row["ticker"]]
        if book.stale:
            continue
        past = [q for q in quotes[row["ticker"]] if q[0] <= wall]
        latest = max(past)
        assert latest[1:] == (book.best(0), book.best(1))
        seen[row["ticker"]] = True
    assert len(seen) > 3


def test_stretches_count_restarts(spark):
    rows, want, mono, high, boots = [], [], 10**15, None, 0
    rng = random.Random(5)
    for n in range(600):
        mono += rng.randrange(1, 30) * SECOND
        if rng.random() < 0.01:
            mono = rng.randrange(1, 2_000) * SECOND
        reading = mono - (rng.randrange(0, 400) * SECOND if rng.random() < 0.1 else 0)
        if high is not None and reading < high - 600 * SECOND:
            boots, high = boots + 1, reading
        else:
            high = reading if high is None else max(high, reading)
        rows.append((n, 10**18 + n * 7 * SECOND, reading, 0))
        want.append(boots)
    df = spark.createDataFrame(rows, "n int, wall bigint, mono bigint, src int")
    got = [r.stretch for r in with_stretch(df, restart_boundaries(df)).orderBy("n").collect()]
    assert boots > 2
    assert got == want


def test_restarts_within_one_crowded_minute(spark):
    """All rows in one minute: only rows near a restart are walked one by one."""
    rows, want, mono, high, boots = [], [], 10**15, None, 0
    rng = random.Random(6)
    for n in range(4_000):
        mono = rng.randrange(1, 2_000) * SECOND if rng.random() < 0.001 else mono + rng.randrange(1, 3) * SECOND
        if high is not None and mono < high - 600 * SECOND:
            boots, high = boots + 1, mono
        else:
            high = mono if high is None else max(high, mono)
        rows.append((n, 6 * 10**18 + n * 10_000_000, mono, 0))
        want.append(boots)
    df = spark.createDataFrame(rows, "n int, wall bigint, mono bigint, src int")
    got = [r.stretch for r in with_stretch(df, restart_boundaries(df)).orderBy("n").collect()]
    assert boots > 1 and got == want
