"""Classify independent book snapshots against the states they could have seen.

A window spans the changes of one market between two monotonic instants. Its states are the starting
levels and the book after each change. A state equals the snapshot exactly when no level differs, so
each change's effect on the number of differing levels is summed instead of comparing whole books.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_MINUTE
from bookstrata.functions.exact import complement, floor_div, parse_count, parse_price
from bookstrata.session import materialize

KEY = ["audit_id", "side", "price_e4"]


def rest_levels(books: DataFrame) -> DataFrame:
    """Level rows of REST books ``(audit_id, ticker, yes_dollars, no_dollars)``.

    NO bids are always complemented onto the YES scale; zero counts are dropped; a malformed price
    or count makes the whole book invalid.
    """

    def side(column: str, number: int, flip: bool):
        def level(pair):
            price = parse_price(F.get(pair, F.lit(0)))
            return F.struct(
                F.lit(number).cast("tinyint").alias("side"),
                (complement(price) if flip else price).cast("int").alias("price_e4"),
                parse_count(F.get(pair, F.lit(1))).alias("count_e2"),
            )

        return F.transform(F.coalesce(column, F.array().cast("array<array<string>>")), level)

    both = F.concat(side("yes_dollars", 0, False), side("no_dollars", 1, True))
    whole = books.withColumn("levels", both).withColumn(
        "valid", F.forall("levels", lambda v: v["price_e4"].isNotNull() & v["count_e2"].isNotNull())
    )
    rows = whole.where("valid").select("audit_id", "ticker", F.inline("levels"))
    return rows.where(F.col("count_e2") != 0)


def window_changes(audits: DataFrame, changes: DataFrame, bucket_ns: int = NS_PER_MINUTE) -> DataFrame:
    """Changes of each audit's market received in its window ``[open, close]``.

    Both sides are bucketed by time, so a busy market is joined minute by minute.
    """
    opened, closed = F.col("window_open_mono_ns"), F.col("window_close_mono_ns")
    probe = audits.select(
        "audit_id", "ticker", "window_open_mono_ns", "window_close_mono_ns",
        F.explode(F.sequence(floor_div(opened, bucket_ns), floor_div(closed, bucket_ns))).alias("bucket"),
    )
    rows = changes.withColumn("bucket", floor_div("mono", bucket_ns))
    return (
        probe.join(rows, ["ticker", "bucket"])
        .where(F.col("mono").between(opened, closed))
        .drop("bucket", "window_open_mono_ns", "window_close_mono_ns")
    )


def classify_windows(
    audits: DataFrame,
    start_levels: DataFrame,
    events: DataFrame,
    rest: DataFrame,
    max_events: int = 100_000,
) -> DataFrame:
    """Judge every audit.

    A window is one market for the seconds of one request, and more than ``max_events`` changes
    make it undecidable by rule, so the work per audit is bounded.

    What several steps read is written to the shared folder. All steps are keyed by audit, so they would otherwise
    become one stage of a hundred sorts and windows, each of which holds a page of memory whatever its rows.

    Args:
        audits: ``audit_id, ticker, reply_mono_ns, has_book`` and ``went_stale`` (the book was stale
            at some point of the window).
        start_levels: ``audit_id, side, price_e4, count_e2`` as the window opened.
        events: ``audit_id, idx`` (from 1), ``mono``, and either a change of one level (``side,
            price_e4, delta_e2``) or an image (``levels`` array, ``delta_e2`` NULL).
        rest: ``audit_id, side, price_e4, count_e2`` of the snapshot.
        max_events: Most changes a window may hold.
    """
    events = materialize(events, "window-events")
    sizes = events.groupBy("audit_id").agg(
        F.countDistinct("idx").alias("window_events"),
    )
    judged = audits.join(sizes, "audit_id", "left").withColumn(
        "window_events", F.coalesce("window_events", F.lit(0))
    )
    fault = (
        F.when(~F.col("has_book"), "no_book")
        .when(F.col("window_events") > max_events, "overflow")
        .when(F.col("went_stale"), "stale")
    )
    judged = materialize(judged.withColumn("fault", fault), "judged")
    open_ids = judged.where(F.col("fault").isNull()).select("audit_id", "reply_mono_ns")
    live = materialize(events.join(open_ids, "audit_id"), "live")
    late = live.where(F.col("mono") > F.col("reply_mono_ns")).groupBy("audit_id").agg(
        (F.min("idx") - 1).alias("before_late")
    )
    known = judged.where(F.col("fault").isNull()).select("audit_id", "window_events")
    reply = known.join(late, "audit_id", "left").select(
        "audit_id",
        F.coalesce("before_late", "window_events", F.lit(0)).cast("bigint").alias("reply_index"),
    )
    reply = materialize(reply, "reply")
    images = live.where(F.col("delta_e2").isNull())
    parts = live.where(F.col("delta_e2").isNotNull()).select(
        *KEY, "idx", F.col("delta_e2").alias("add"), F.lit(None).cast("bigint").alias("set")
    )
    imaged = images.select("audit_id", "idx", F.inline("levels")).where(F.col("side") >= 0)
    began = start_levels.join(open_ids.select("audit_id"), "audit_id", "left_semi")
    snap = rest.join(open_ids.select("audit_id"), "audit_id", "left_semi")
    every = (
        parts.select(*KEY).unionByName(imaged.select(*KEY)).unionByName(began.select(*KEY))
        .unionByName(snap.select(*KEY)).distinct()
    )
    every = materialize(every, "window-levels")
    # An image sets every level of the window's levels, to zero where it does not list one.
    wiped = (
        images.select("audit_id", "idx").join(every, "audit_id")
        .join(imaged.select(*KEY, "idx", "count_e2"), [*KEY, "idx"], "left")
        .select(*KEY, "idx", F.lit(0).cast("bigint").alias("add"), F.coalesce("count_e2", F.lit(0)).alias("set"))
    )
    opening = every.join(began, KEY, "left").select(
        *KEY, F.lit(0).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("add"),
        F.coalesce("count_e2", F.lit(0)).alias("set"),
    )
    moves = opening.unionByName(wiped).unionByName(parts)
    level = Window.partitionBy(*KEY).orderBy("idx")
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    moves = moves.withColumn("base_no", F.count("set").over(upto))
    in_base = Window.partitionBy(*KEY, "base_no").orderBy("idx")
    moves = moves.withColumn(
        "held", F.sum(F.coalesce("set", F.lit(0)) + F.col("add")).over(in_base.rowsBetween(Window.unboundedPreceding, 0))
    )
    target = snap.select(*KEY, F.col("count_e2").alias("want"))
    moves = moves.join(target, KEY, "left").withColumn("want", F.coalesce("want", F.lit(0)))
    off = F.when(F.col("held") != F.col("want"), 1).otherwise(0)
    moves = moves.withColumn("off", off)
    moves = moves.withColumn("step", F.col("off") - F.coalesce(F.lag("off").over(level), F.lit(0)))
    moves = materialize(moves, "moves")
    states = moves.groupBy("audit_id", "idx").agg(F.sum("step").alias("step"))
    walk = Window.partitionBy("audit_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    matches = states.withColumn("wrong", F.sum("step").over(walk)).where(F.col("wrong") == 0)
    # No level anywhere: every state is the same empty book, so the reply's own state matches.
    blank = reply.join(every.select("audit_id").distinct(), "audit_id", "left_anti").select(
        "audit_id", F.col("reply_index").alias("idx"), "reply_index"
    )
    near = (
        matches.select("audit_id", "idx").join(reply, "audit_id").unionByName(blank)
        .groupBy("audit_id")
        .agg(F.min(F.struct(F.abs(F.col("idx") - F.col("reply_index")).alias("away"), F.col("idx"))).alias("m"))
        .select("audit_id", F.col("m.idx").alias("match_index"))
    )
    near = materialize(near, "near")
    at_reply = (
        moves.join(reply, "audit_id").where(F.col("idx") <= F.col("reply_index"))
        .groupBy(*KEY).agg(F.max_by("held", "idx").alias("held"), F.max("want").alias("want"))
    )
    diff = at_reply.groupBy("audit_id").agg(
        F.count(F.when(F.col("held") > 0, 1)).alias("levels_local"),
        F.count(F.when(F.col("held") != F.col("want"), 1)).alias("mismatched_levels"),
        F.max(F.abs(F.col("held") - F.col("want"))).alias("max_abs_diff_e2"),
    )
    diff = materialize(diff, "diff")
    counted = rest.groupBy("audit_id").agg(F.count(F.lit(1)).alias("levels_rest"))
    joined = (
        judged.join(reply, "audit_id", "left").join(near, "audit_id", "left")
        .join(diff, "audit_id", "left").join(counted, "audit_id", "left")
    )
    decided = F.col("fault").isNull()
    outcome = (
        F.when(~decided, "undecidable")
        .when(F.col("match_index").isNull(), "inconsistent")
        .when(F.col("match_index") == F.col("reply_index"), "exact")
        .otherwise("consistent")
    )
    zero = F.lit(0)
    return joined.select(
        "audit_id", "ticker", outcome.alias("outcome"), "window_events", "match_index",
        F.coalesce("levels_rest", zero).alias("levels_rest"),
        F.when(decided, F.coalesce("levels_local", zero)).alias("levels_local"),
        F.when(decided, F.coalesce("mismatched_levels", zero)).alias("mismatched_levels"),
        F.when(decided, F.coalesce("max_abs_diff_e2", zero)).alias("max_abs_diff_e2"), "fault",
    )


def levels_json(side: str = "side", price: str = "price_e4", count: str = "count_e2"):
    """Aggregate: a book's levels as JSON text, bids before asks, best first."""
    rank = F.when(F.col(side) == 0, -F.col(price)).otherwise(F.col(price))
    item = F.struct(F.col(side).alias("side"), rank.alias("rank"), F.col(price).alias("price_e4"), F.col(count).alias("count_e2"))
    ordered = F.sort_array(F.collect_list(item))
    return F.to_json(
        F.transform(ordered, lambda v: F.struct(v["side"].alias("side"), v["price_e4"].alias("price_e4"), v["count_e2"].alias("count_e2")))
    )


def parse_levels_json(text):
    return F.from_json(text, "array<struct<side: tinyint, price_e4: int, count_e2: bigint>>")
