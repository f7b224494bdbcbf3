"""Classify independent book snapshots against the states that the archive says they could have seen.

A window opens and closes at two readings of the clock, both included. Its states are the book as it
opened and the book after each change in it. Nothing is handed in but the archive's own timeline and the
snapshots: whether there was a fresh book, when it went stale and what it held all follow from replay.

No window is walked and no pair of a state and a snapshot is formed unless they look alike:

* Every state has a *fingerprint*: its levels by side, and sums of hashes over its levels. A change
  alters the sums by the level's hash after it less the one before, so fingerprints are running sums
  over slices.
* A snapshot's nearest state is its nearest row of the same market and fingerprint before and after the
  reply: two as-of joins, however often a book flips back and forth.
* Only the states at the reply and at the match are expanded into levels. Levels rest for stretches of
  change numbers, which are cut into dyadic blocks, so a state meets just the levels resting in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.exact import floor_div
from bookstrata.operators.ordering import minute_block
from bookstrata.operators.replay import ASK, BID, SLICE_ROWS, Timeline, applied_rows, open_at_slice_start
from bookstrata.operators.running import Running, asof_join, dyadic_block, dyadic_blocks, dyadic_levels, running
from bookstrata.session import materialize

MAX_EVENTS = 100_000

Hashes = Callable[[Column, Column, Column], list[Column]]


def level_hashes(side: Column, price: Column, count: Column) -> list[Column]:
    """Two 64-bit hashes of a level as halves of 32 bits, so that sums over any book stay exact."""
    parts = []
    for seed in (1, 2):
        whole = F.xxhash64(F.lit(seed), side.cast("int"), price.cast("int"), count.cast("bigint"))
        parts += [F.shiftright(whole, 32), whole.bitwiseAND(F.lit((1 << 32) - 1))]
    return parts


def _fingerprint(sides: dict[str, Column], hashes: list[Column]) -> dict[str, Column]:
    return sides | {f"hash{i}": h for i, h in enumerate(hashes)}


def book_states(line: Timeline, hashes: Hashes = level_hashes) -> DataFrame:
    """One row per applied change: its number in its market, epoch, reading of the clock, and the fingerprint after it."""
    rows = applied_rows(line.log, line.cuts)
    after, before = F.col("count_e2"), F.col("count_e2") - F.col("delta_e2")
    level = F.col("side"), F.col("price_e4")
    zero = F.lit(0).cast("bigint")

    def moved(now: Column, was: Column) -> Column:
        changed = F.when(after > 0, now).otherwise(zero) - F.when(before > 0, was).otherwise(zero)
        return F.sum(F.when(F.col("side") >= 0, changed).otherwise(zero))

    one = F.lit(1).cast("bigint")
    of = lambda side: F.when(F.col("side") == side, one).otherwise(zero)
    steps = _fingerprint(
        {"bids": moved(of(BID), of(BID)), "asks": moved(of(ASK), of(ASK))},
        [moved(now, was) for now, was in zip(hashes(*level, after), hashes(*level, before), strict=True)],
    )
    events = rows.groupBy("ticker", "epoch", "slice", "rank").agg(
        F.min("pos.stretch").alias("stretch"), F.min("pos.mono").alias("mono"), *[c.alias(name) for name, c in steps.items()]
    )
    events = materialize(events, "book-events")
    sums = {name: Running("sum", F.col(name)) for name in steps}
    return materialize(running(events, ["ticker", "epoch"], ["slice"], ["rank"], sums), "book-states")


def _windows(line: Timeline, states: DataFrame, audits: DataFrame, max_events: int) -> DataFrame:
    """Each audit's change numbers at opening, reply and closing, its fault and its number of changes."""
    here = F.struct("stretch", "mono")
    block = F.struct("stretch", minute_block("mono").alias("minute"))
    known = audits.where(
        F.col("ticker").isNotNull() & F.col("stretch").isNotNull() & F.col("window_open_mono_ns").isNotNull()
        & F.col("reply_mono_ns").isNotNull() & F.col("window_close_mono_ns").isNotNull()
    )
    instants = {"opened": F.col("window_open_mono_ns") - 1, "replied": F.col("reply_mono_ns"), "closed": F.col("window_close_mono_ns")}
    probes = known.select(
        "audit_id", "ticker", "stretch",
        F.inline(F.array(*[F.struct(F.lit(name).alias("what"), at.alias("mono")) for name, at in instants.items()])),
    )
    found = asof_join(probes, states, ["ticker"], here, here, block, block, ["rank", "epoch"])
    at = lambda name, value: F.max(F.when(F.col("what") == name, F.col(value)))
    placed = found.groupBy("audit_id").agg(*[at(n, "rank").alias(n) for n in instants], at("opened", "epoch").alias("epoch"))

    # The market's first cut from the opening on, with the last change applied before it.
    cuts = line.cuts.select("ticker", "epoch", "cut.stretch", "cut.mono")
    lasts = states.groupBy("ticker", "epoch").agg(F.max("rank").alias("last_rank"))
    openings = known.select("audit_id", "ticker", "stretch", F.col("window_open_mono_ns").alias("mono"))
    spoiled = asof_join(
        openings, cuts.join(lasts, ["ticker", "epoch"], "left"), ["ticker"], here, here, block, block, ["last_rank"], forward=True
    ).select("audit_id", F.col("found_at").alias("spoiled_at"), "last_rank")

    own = cuts.select("ticker", "epoch", F.struct("stretch", "mono").alias("own_cut"))
    rows = audits.join(placed, "audit_id", "left").join(spoiled, "audit_id", "left").join(own, ["ticker", "epoch"], "left")
    instant = lambda name: F.struct(F.col("stretch").cast("int").alias("stretch"), F.col(name).cast("bigint").alias("mono"))
    fresh = F.col("opened").isNotNull() & F.coalesce(F.col("own_cut") >= instant("window_open_mono_ns"), F.lit(True))
    stales = F.coalesce(F.col("spoiled_at") <= instant("window_close_mono_ns"), F.lit(False))
    seen = F.when(stales, F.greatest("opened", "last_rank")).otherwise(F.col("closed")) - F.col("opened")
    fault = F.when(~fresh, "no_book").when(seen > max_events, "overflow").when(stales, "stale")
    events = F.when(~fresh, F.lit(0)).otherwise(F.least(seen, F.lit(max_events))).cast("bigint")
    replied = F.greatest("opened", F.least("replied", "closed"))
    return rows.select("audit_id", "ticker", "opened", replied.alias("replied"), "closed", fault.alias("fault"), events.alias("window_events"))


def books_at_changes(line: Timeline, asked: DataFrame, states: DataFrame) -> DataFrame:
    """Levels resting after given changes.

    Args:
        line: The timeline.
        asked: ``ticker`` and ``rank``, the number of an applied change, and any other columns.
        states: Output of :func:`book_states`.

    Returns:
        The columns of ``asked`` with ``side``, ``price_e4`` and ``count_e2``; an empty book has no row.
    """
    size = line.slice_rows + 1
    asked = asked.withColumn("slice", floor_div("rank", line.slice_rows).cast("int"))
    asked = asked.join(states.select("ticker", "slice", "rank", "epoch"), ["ticker", "slice", "rank"])
    key = ["ticker", "epoch", "slice"]
    rows = applied_rows(line.log, line.cuts)
    held = rows.where(F.col("side") >= 0).select(*key, "side", "price_e4", "count_e2", "rank")
    carried = open_at_slice_start(rows).select(
        *key, "side", "price_e4", "count_e2", (F.col("slice").cast("bigint") * line.slice_rows - 1).alias("rank")
    )
    held = held.unionByName(carried).join(asked.select(*key).distinct(), key, "left_semi")
    following = F.lead("rank").over(Window.partitionBy(*key, "side", "price_e4").orderBy("rank"))
    held = held.withColumn("end", F.coalesce(following, (F.col("slice").cast("bigint") + 1) * line.slice_rows))
    held = held.where(F.col("count_e2") > 0).select(
        *key, "side", "price_e4", "count_e2", F.inline(dyadic_blocks("rank", "end", F.lit(size)))
    )
    blocks = F.transform(dyadic_levels(F.lit(size)), lambda h: F.struct(h.alias("level"), dyadic_block("rank", h).alias("block")))
    return asked.select("*", F.inline(blocks)).join(held, [*key, "level", "block"]).drop("epoch", "slice", "level", "block")


def audits_from_archive(
    line: Timeline, audits: DataFrame, rest: DataFrame, max_events: int = MAX_EVENTS, hashes: Hashes = level_hashes
) -> DataFrame:
    """Judge every audit by the archive.

    Args:
        line: The timeline of the archive around the windows; it must reach back to an image or keyframe.
        audits: ``audit_id`` (unique), ``ticker``, ``stretch`` (the host boot, see ``with_stretch``), ``reply_mono_ns``,
            ``window_open_mono_ns`` and ``window_close_mono_ns``. An audit with a NULL among these is ``no_book``.
        rest: ``audit_id, side, price_e4, count_e2`` of the snapshots, no level twice. An audit without rows saw an empty book.
        max_events: Most changes a window may hold.
        hashes: Hashes of a level that make up fingerprints.

    Returns:
        ``audit_id, ticker, outcome, window_events, match_index, levels_rest, levels_local, mismatched_levels,
        max_abs_diff_e2, fault`` as of ``classify_windows``; counts of changes stop at a fault. A match is nearest to
        the reply, the earlier one on a tie, and is confirmed level by level: should a fingerprint agree where levels
        do not, the audit is ``undecidable`` with the fault ``collision``.
    """
    states = book_states(line, hashes)
    windows = materialize(_windows(line, states, audits, max_events), "windows")
    wanted = _fingerprint(
        {side: F.count(F.when(F.col("side") == number, 1)) for side, number in (("bids", BID), ("asks", ASK))},
        [F.sum(h) for h in hashes(F.col("side"), F.col("price_e4"), F.col("count_e2"))],
    )
    marks = list(wanted)
    prints = rest.groupBy("audit_id").agg(*[c.cast("bigint").alias(name) for name, c in wanted.items()])
    decided = windows.where(F.col("fault").isNull()).join(prints, "audit_id", "left").fillna(0, marks)

    # The nearest state that looks like the snapshot, before and after the reply.
    keys = ["ticker", *marks]
    alike = states.join(decided.select(*keys).distinct(), keys, "left_semi")
    replied, rank = F.col("replied"), F.col("rank")
    blocks = floor_div("replied", SLICE_ROWS), floor_div("rank", SLICE_ROWS)
    back = asof_join(decided, alike, keys, replied, rank, *blocks, []).withColumnRenamed("found_at", "back")
    both = asof_join(back, alike, keys, replied, rank, *blocks, [], forward=True, allow_equal=False)
    back = F.when(F.col("back") >= F.col("opened"), F.col("back"))
    ahead = F.when(F.col("found_at") <= F.col("closed"), F.col("found_at"))
    nearer = back.isNotNull() & F.coalesce(replied - back <= ahead - replied, F.lit(True))
    both = both.select("audit_id", "ticker", "opened", "replied", F.when(nearer, back).otherwise(ahead).alias("matched"))
    both = materialize(both, "matches")

    roles = F.array(*[F.struct(F.lit(name).alias("role"), F.col(name).alias("rank")) for name in ("replied", "matched")])
    asked = both.select("audit_id", "ticker", F.inline(roles)).where(F.col("rank").isNotNull())
    local = books_at_changes(line, asked, states).select(
        "audit_id", "role", F.col("side").cast("int").alias("side"), "price_e4", F.col("count_e2").alias("held"), F.lit(0).cast("bigint").alias("want")
    )
    given = asked.select("audit_id", "role").join(rest, "audit_id").select(
        "audit_id", "role", F.col("side").cast("int").alias("side"), "price_e4", F.lit(0).cast("bigint").alias("held"), F.col("count_e2").alias("want")
    )
    levels = local.unionByName(given).groupBy("audit_id", "role", "side", "price_e4").agg(F.sum("held").alias("held"), F.sum("want").alias("want"))
    at_reply, off = F.col("role") == "replied", F.col("held") != F.col("want")
    diff = levels.groupBy("audit_id").agg(
        F.count(F.when(at_reply & (F.col("held") > 0), 1)).alias("levels_local"),
        F.count(F.when(at_reply & off, 1)).alias("mismatched_levels"),
        F.max(F.when(at_reply, F.abs(F.col("held") - F.col("want")))).alias("max_abs_diff_e2"),
        F.count(F.when(~at_reply & off, 1)).alias("wrong"),
    )
    counted = rest.groupBy("audit_id").agg(F.count(F.lit(1)).alias("levels_rest"))
    rows = (
        windows.join(both.select("audit_id", "matched"), "audit_id", "left").join(diff, "audit_id", "left").join(counted, "audit_id", "left")
    )
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(F.coalesce("wrong", zero) > 0, "collision")))
    sound = F.col("fault").isNull()
    outcome = (
        F.when(~sound, "undecidable")
        .when(F.col("matched").isNull(), "inconsistent")
        .when(F.col("matched") == F.col("replied"), "exact")
        .otherwise("consistent")
    )
    return rows.select(
        "audit_id", "ticker", outcome.alias("outcome"), "window_events",
        F.when(sound, F.col("matched") - F.col("opened")).alias("match_index"),
        F.coalesce("levels_rest", zero).alias("levels_rest"),
        *[F.when(sound, F.coalesce(c, zero)).alias(c) for c in ("levels_local", "mismatched_levels", "max_abs_diff_e2")],
        "fault",
    )
