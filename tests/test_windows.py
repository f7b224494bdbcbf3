"""Brute-force checks of audits, intervals and as-of joins on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from bookstrata.operators import audits as A
from bookstrata.operators import replay as R
from bookstrata.operators import running as N
from bookstrata.operators.intervals import covered_ns, overlap_ns, union_intervals
from bookstrata.operators.running import Running, asof_join, running
from tests.sequential import run
from tests.test_replay import as_dict, make_feed, to_tables

LEVELS = "array<struct<side:tinyint,price_e4:int,count_e2:bigint>>"


def judge(start, events, rest, reply):
    states, book = [dict(start)], dict(start)
    for _, kind, payload in events:
        if kind == "S":
            book = {(s, p): c for s, p, c in payload}
        else:
            side, price, change = payload
            book = dict(book)
            book[side, price] = book.get((side, price), 0) + change
            book = {k: v for k, v in book.items() if v}
        states.append(book)
    index = sum(1 for e in events if e[0] <= reply)
    matches = [i for i, s in enumerate(states) if s == rest]
    if not matches:
        return "inconsistent", None
    best = min(matches, key=lambda i: (abs(i - index), i))
    return ("exact" if best == index else "consistent"), best


def test_audits_equal_exhaustive_search(spark):
    rng = random.Random(8)
    audits, starts, events, rests, want = [], [], [], [], {}
    for a in range(60):
        start = {(s, 4000 + 1000 * s): 10 for s in (0, 1) if rng.random() < 0.8}
        mono, own = 0, []
        for _ in range(rng.randrange(0, 7)):
            mono += rng.randrange(1, 4)
            if rng.random() < 0.2:
                own.append((mono, "S", [(s, 4000 + 1000 * s, 10) for s in (0, 1) if rng.random() < 0.7]))
            else:
                side = rng.randrange(2)
                own.append((mono, "D", (side, 4000 + 1000 * side, rng.choice([5, 5, -5]))))
        rest = {(s, 4000 + 1000 * s): rng.choice([5, 10, 15]) for s in (0, 1) if rng.random() < 0.8}
        reply = rng.randrange(0, 12)
        audits.append((a, "M", reply, True, False))
        starts += [(a, s, p, c) for (s, p), c in start.items()]
        rests += [(a, s, p, c) for (s, p), c in rest.items()]
        for i, (m, kind, payload) in enumerate(own, 1):
            if kind == "S":
                events.append((a, i, m, None, None, None, payload))
            else:
                events.append((a, i, m, *payload, None))
        want[a] = judge(start, own, rest, reply)
    level = "audit_id int, side tinyint, price_e4 int, count_e2 bigint"
    got = A.classify_windows(
        spark.createDataFrame(audits, "audit_id int, ticker string, reply_mono_ns bigint, has_book boolean, went_stale boolean"),
        spark.createDataFrame(starts, level),
        spark.createDataFrame(events, f"audit_id int, idx bigint, mono bigint, side tinyint, price_e4 int, delta_e2 bigint, levels {LEVELS}"),
        spark.createDataFrame(rests, level),
    )
    assert {r.audit_id: (r.outcome, r.match_index) for r in got.collect()} == want


def test_audits_are_judged_in_short_stages(spark):
    """Everything is keyed by audit, so without files in between all sorts and windows would be one stage."""
    level = "audit_id int, side tinyint, price_e4 int, count_e2 bigint"
    levels = spark.createDataFrame([(1, 0, 4000, 5)], level)
    got = A.classify_windows(
        spark.createDataFrame([(1, "M", 5, True, False)], "audit_id int, ticker string, reply_mono_ns bigint, has_book boolean, went_stale boolean"),
        levels, spark.createDataFrame([(1, 1, 3, 0, 4000, 5, None)], f"audit_id int, idx bigint, mono bigint, side tinyint, price_e4 int, delta_e2 bigint, levels {LEVELS}"),
        levels,
    )
    assert [(r.outcome, r.match_index, r.levels_local, r.max_abs_diff_e2) for r in got.collect()] == [("consistent", 0, 1, 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") <= 4


def test_interval_union_and_overlap(spark):
    rng = random.Random(3)
    a = [(k, s, s + rng.randrange(0, 30)) for k in range(3) for s in (rng.randrange(0, 300) for _ in range(15))]
    b = [(k, s, s + rng.randrange(0, 30)) for k in range(3) for s in (rng.randrange(0, 300) for _ in range(15))]
    schema = "k int, start_wall_ns bigint, end_wall_ns bigint"
    ua = union_intervals(spark.createDataFrame(a, schema), ["k"], block_ns=40)
    ub = union_intervals(spark.createDataFrame(b, schema), ["k"], block_ns=40)
    cover = lambda rows, k: {t for kk, s, e in rows if kk == k for t in range(s, e)}
    got = {r.k: r.covered_ns for r in covered_ns(ua, ["k"]).collect()}
    both = {r.k: r.overlap_ns for r in overlap_ns(ua, ub, ["k"], block_ns=40).collect()}
    for k in range(3):
        assert got[k] == len(cover(a, k))
        assert both.get(k, 0) == len(cover(a, k) & cover(b, k))


@pytest.mark.parametrize("forward,equal", [(False, True), (False, False), (True, True), (True, False)])
def test_asof(spark, forward, equal):
    rng = random.Random(6)
    left = [(n, rng.randrange(2), rng.randrange(200)) for n in range(60)]
    right = [(rng.randrange(2), at, at * 7) for at in rng.sample(range(200), 40)]
    got = asof_join(
        spark.createDataFrame(left, "n int, k int, at bigint"), spark.createDataFrame(right, "k int, t bigint, v bigint"), ["k"],
        F.col("at"), F.col("t"), F.expr("at div 16"), F.expr("t div 16"), ["v"], forward=forward, allow_equal=equal,
    )
    seen = {r.n: r.v for r in got.collect()}
    for n, k, at in left:
        fits = [t for kk, t, _ in right if kk == k and ((t > at if forward else t < at) or (equal and t == at))]
        best = (min(fits) if forward else max(fits)) if fits else None
        assert seen[n] == (None if best is None else best * 7)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_in_one_block_is_linear(spark, forward):
    """No frame reaches to the last row: Spark would evaluate it anew for every row, the square of a block's rows."""
    left, right = spark.range(20_000).selectExpr("0 AS k", "id * 3 AS at"), spark.range(5_000).selectExpr("0 AS k", "id * 12 AS t")
    got = asof_join(left, right, ["k"], F.col("at"), F.col("t"), F.lit(0), F.lit(0), [], forward=forward)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
    want = (lambda at: -(-at // 12) * 12 if at <= 59_988 else None) if forward else lambda at: at // 12 * 12
    rows = got.collect()
    assert len(rows) == 20_000 and all(r.found_at == want(r["at"]) for r in rows)


@pytest.fixture
def four_ranges(spark, monkeypatch):
    """What as-of joins lay out, in as many ranges as the session has shuffle partitions, however small."""
    written, real, name = {}, N.materialize, "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(N, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield written
    spark.conf.set(name, before)


def _largest_share(laid):
    rows = [r["count"] for r in laid.groupBy("__block").count().collect()]
    return max(rows) / sum(rows)


@pytest.mark.parametrize("forward,equal", [(False, True), (False, False), (True, True), (True, False)])
def test_asof_in_ranges(spark, four_ranges, forward, equal):
    """Without blocks the rows of one key spread, also the 1,000 left ones of one instant."""
    rng = random.Random(7)
    left = [(n, 0, 5 if n < 1_000 else rng.randrange(12)) for n in range(1_200)]
    right = [(0, at, at * 7) for at in (1, 5, 8)]
    got = asof_join(
        spark.createDataFrame(left, "n int, k int, at bigint"), spark.createDataFrame(right, "k int, t bigint, v bigint"), ["k"],
        F.col("at"), F.col("t"), None, None, ["v"], forward=forward, allow_equal=equal,
    )
    seen = {r.n: r.v for r in got.collect()}
    for n, _, at in left:
        fits = [t for _, t, _ in right if (t > at if forward else t < at) or (equal and t == at)]
        assert seen[n] == ((min(fits) if forward else max(fits)) * 7 if fits else None)
    assert _largest_share(four_ranges["asof"]) < 0.5


def test_gaps_of_one_minute_spread(spark, four_ranges):
    """A feed received within one minute, three events a reading: gaps are found in ranges, with the books of a walk."""
    feed = []
    for n, (_, _, kind, r) in enumerate(make_feed(11, tickers=30, events=1_500, calm=True)):
        at = n // 3 * 1_000
        feed.append((10**18 + at, at, kind, {**r, "conn_id": 0, "ts_ms": n} if kind == "D" else {**r, "conn_id": 0}))
    want = {t: (b.stale, b.ts, b.levels) for t, b in run(feed).items()}
    assert as_dict(R.replay(*to_tables(spark, feed), slice_rows=16)) == want
    laid = four_ranges["asof"]
    assert laid.where("__right = 1").count() > 10 and laid.select("conn_id").distinct().count() == 1
    assert _largest_share(laid) < 0.5


def test_running_over_blocks(spark):
    rng = random.Random(7)
    rows = [(k, at, rng.choice([None, 1, 5, -2])) for k in range(2) for at in rng.sample(range(500), 80)]
    df = spark.createDataFrame(rows, "k int, at int, v bigint").withColumn("block", F.expr("at div 32"))
    specs = {
        "s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), current=False), "l": Running("last", F.col("v"), current=False),
    }
    got = {(r.k, r["at"]): (r.s, r.m, r.l) for r in running(df, ["k"], ["block"], ["at"], specs).collect()}
    for k in range(2):
        past = []
        for _, at, v in sorted(r for r in rows if r[0] == k):
            known = [p for p in past if p is not None]
            total = sum(known) + (v or 0)
            assert got[k, at] == (total, max(known, default=None), known[-1] if known else None)
            past.append(v)
