import random

import pytest
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_MINUTE, RESTART_DROP_NS
from bookstrata.operators import ordering as O
from bookstrata.operators import replay as R
from tests.test_replay import SECOND, as_dict, to_tables
from tests.sequential import run


def walk(readings):
    """Restarts among (wall, src, mono), one after the other."""
    highest, found = None, []
    for wall, src, mono in sorted(readings):
        if highest is not None and mono < highest - RESTART_DROP_NS:
            found.append((wall, src, mono))
            highest = mono
        else:
            highest = mono if highest is None else max(highest, mono)
    return found


def feed(seed, n, clocks, restart):
    """Readings of several clocks, hours apart, that interleave; each may start again."""
    rng = random.Random(seed)
    offsets = [k * 5 * RESTART_DROP_NS for k in range(clocks)]
    wall, rows = 10**18, []
    for _ in range(n):
        wall += rng.randrange(1, 20) * SECOND
        k = rng.randrange(clocks)
        if rng.random() < restart:
            offsets[k] = rng.randrange(3) * RESTART_DROP_NS - (wall - 10**18)
        rows.append((wall, rng.randrange(3), wall - 10**18 + offsets[k] + rng.randrange(-3, 3) * NS_PER_MINUTE))
    return rows


@pytest.mark.parametrize("seed,clocks,restart", [(1, 1, 0.0), (2, 1, 0.01), (3, 2, 0.0), (4, 3, 0.02)])
def test_restarts_equal_a_walk(spark, monkeypatch, seed, clocks, restart):
    monkeypatch.setattr(O, "BLOCK_ROWS", 8)
    rows = feed(seed, 700, clocks, restart)
    got = O.restarts(spark.createDataFrame(rows, "wall long, src int, mono long")).collect()
    assert sorted(tuple(r) for r in got) == walk(rows)


def test_no_step_gathers_all_blocks(spark):
    """The only step without a key has one row for each partition of the sort."""
    plan = O.restarts(spark.createDataFrame(feed(5, 200, 2, 0.0), "wall long, src int, mono long"))
    assert "FlatMapCoGroupsInPandas" in plan._jdf.queryExecution().toString()
    assert plan.rdd.getNumPartitions() >= 1


@pytest.mark.parametrize("seed", range(6))
def test_effects_compose(seed):
    """An effect says for any highest reading what walking the run would, and so does a chain of effects."""
    rng = random.Random(seed)
    span = 3 * RESTART_DROP_NS
    items = [(rng.randrange(span), rng.random() < 0.8) for _ in range(60)]

    def walked(highest, part):
        for reading, raw in part:
            if raw and highest is not None and reading < highest - RESTART_DROP_NS:
                highest = reading
            else:
                highest = reading if highest is None else max(highest, reading)
        return highest

    def effect(part):
        out = O.Effect()
        for reading, raw in reversed(part):
            out.after(reading, raw)
        return out

    cuts = sorted(rng.sample(range(1, 60), 5))
    chain = O.Effect()
    for a, b in zip([0, *cuts], [*cuts, 60]):
        chain = chain.then(effect(items[a:b]))
    edges = [x + d for x, _ in items for d in (-1, 0, 1, RESTART_DROP_NS - 1, RESTART_DROP_NS, RESTART_DROP_NS + 1)]
    for highest in [None, -span, 3 * span, *edges]:
        assert effect(items).of(highest) == chain.of(highest) == walked(highest, items)


def test_ranks(spark):
    rows = [(f"M{k % 3 if k % 2 else 0}", k * 37 % 1000) for k in range(1000)]
    got = O.ranked(spark.createDataFrame(rows, "ticker string, at int"), ["ticker"], "at", "ranks").collect()
    for ticker in {t for t, _ in rows}:
        own = sorted((r.rank, r["at"]) for r in got if r.ticker == ticker)
        assert own == list(enumerate(sorted(at for t, at in rows if t == ticker)))


def test_hot_minute_is_cut(spark):
    """20,000 changes of one market in one minute, many at one reading, make as many slices as they fill."""
    n, rng = 20_000, random.Random(8)
    start, rows = 10**18, []
    rows.append((start, SECOND, "S", {"ticker": "M0", "conn_id": 0, "sid": 1, "seq": 0, "levels": [(0, 4000, 500), (1, 6000, 500)]}))
    for k in range(1, n):
        side = rng.randrange(2)
        price = (4000 if side == 0 else 6000) + 100 * rng.randrange(8)
        at = k // 50 * 1_000
        rows.append((start + at, SECOND + at + 1, "D", {"ticker": "M0", "conn_id": 0, "sid": 1, "seq": k, "side": side, "price_e4": price, "delta_e2": rng.choice([50, 60, 70]), "ts_ms": k}))
    tables = to_tables(spark, rows)
    changes, _ = R.ordered_changes(*tables)
    slices = R._sliced(changes, 16).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    assert slices.count() == n // 16 and slices.agg(F.max("n")).first()[0] == 16
    want = {t: (b.stale, b.ts, b.levels) for t, b in run(rows).items()}
    assert as_dict(R.replay(*tables, slice_rows=512)) == want
