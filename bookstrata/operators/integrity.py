"""Integrity facts of an archive: connection spans, sleeps, gaps and their cost, daily summaries.

Windows keyed by segment are bounded by one recorded file, which is one connection's hour.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import (
    CLOCK_JUMP_NS,
    NS_PER_HOUR,
    NS_PER_S,
    SECONDS_PER_DAY,
    is_clock_jump,
    parse_hour_label,
)
from bookstrata.functions.exact import floor_div
from bookstrata.operators.intervals import clip_to_days, covered_ns, overlap_ns, union_intervals
from bookstrata.operators.running import Running, asof_join, dyadic_block, dyadic_blocks, dyadic_levels, running
from bookstrata.session import materialize

ORDINAL_BLOCK = 1 << 16


# ---------------------------------------------------------------- connections and host sleep


def connection_spans(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """Open stretches of every connection as each segment shows them.

    A segment whose first record is neither ``open`` nor ``error`` continues a connection and counts
    as open since its hour began. A stretch without a close ends at the segment's last record.
    """
    event = F.col("conn.event")
    good = (F.col("kind") == 4) & (F.col("outcome") == "not_baked")
    marks = classified.where(good & event.isin("open", "close")).select(
        "segment", "hour_label", "ordinal", F.col("recv_wall_ns").alias("wall"), event.alias("event")
    )
    first = classified.groupBy("hour_label", "segment").agg(
        F.min_by(F.when(good, event), "ordinal").alias("first_event"),
        F.min("ordinal").alias("ordinal"),
        F.max_by("recv_wall_ns", "ordinal").alias("last_wall"),
        F.max_by("conn_id", "ordinal").alias("conn_id"),
    )
    carried = first.where(~F.coalesce(F.col("first_event").isin("open", "error"), F.lit(False)))
    implicit = carried.select(
        "segment", "hour_label", (F.col("ordinal") - 1).alias("ordinal"),
        parse_hour_label("hour_label").alias("wall"), F.lit("continued").alias("event"),
    )
    order = Window.partitionBy("segment").orderBy("ordinal")
    steps = (
        marks.unionByName(implicit)
        .withColumn("next_wall", F.lead("wall").over(order))
        .withColumn("next_event", F.lead("event").over(order))
        .where(F.col("event") != "close")
        .join(first.select("segment", "last_wall", "conn_id"), "segment")
    )
    end = F.coalesce("next_wall", "last_wall")
    return steps.select(
        "hour_label", "segment", "conn_id", F.col("wall").alias("start_wall_ns"),
        F.greatest("wall", end).alias("end_wall_ns"), (F.col("event") == "open").alias("opened"),
        F.coalesce(F.col("next_event") == "close", F.lit(False)).alias("closed"),
    )


def host_sleeps(classified: DataFrame) -> DataFrame:
    """Distinct stretches the host slept, from its clock-jump records."""
    c = F.col("conn")
    excess = c["wall_ns_delta"] - c["mono_ns_delta"]
    rows = classified.where(
        (F.col("kind") == 4) & (F.col("outcome") == "not_baked") & (c["event"] == "clock_jump")
        & (excess > 0)
    )
    return rows.select(
        "hour_label", (F.col("recv_wall_ns") - excess).alias("start_wall_ns"),
        F.col("recv_wall_ns").alias("end_wall_ns"),
    ).dropDuplicates()


def clock_jumps(
    records: DataFrame,
    keys: list[str],
    block: list[str],
    order: list[str],
    threshold_ns: int = CLOCK_JUMP_NS,
) -> DataFrame:
    """Consecutive receipts between which wall time outran monotonic time, as sleeps."""
    both = F.struct("recv_wall_ns", "recv_mono_ns")
    rows = running(records, keys, block, order, {"prev": Running("last", both, current=False)})
    wall = F.col("recv_wall_ns") - F.col("prev.recv_wall_ns")
    mono = F.col("recv_mono_ns") - F.col("prev.recv_mono_ns")
    return rows.where(is_clock_jump(wall, mono, threshold_ns)).select(
        *keys, (F.col("recv_wall_ns") - (wall - mono)).alias("start_wall_ns"),
        F.col("recv_wall_ns").alias("end_wall_ns"),
    )


def overflow_dropped(classified: DataFrame) -> DataFrame:
    c = F.col("conn")
    rows = classified.where(
        (F.col("kind") == 4) & (F.col("outcome") == "not_baked") & (c["event"] == "writer_overflow")
    )
    return rows.groupBy("hour_label").agg(F.sum(c["dropped"]).alias("dropped"))


def join_continued_spans(spans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Join spans of one connection that were cut only because a new file began.

    A span continues the one before it when that one was not closed and it was not opened itself.
    """
    rows = spans.withColumn("block", floor_div("start_wall_ns", NS_PER_HOUR))
    order = ["start_wall_ns", "end_wall_ns"]
    who = ["conn_id", *keys]
    rows = running(rows, who, ["block"], order, {"was_closed": Running("last", F.col("closed"), current=False)})
    begins = F.col("opened") | F.coalesce(F.col("was_closed"), F.lit(True))
    step = F.when(begins, 1).otherwise(0)
    rows = running(rows, who, ["block"], order, {"island": Running("sum", step)})
    return rows.groupBy(*who, "island").agg(
        F.min("start_wall_ns").alias("start_wall_ns"), F.max("end_wall_ns").alias("end_wall_ns")
    )


def uptime(spans: DataFrame, sleeps: DataFrame) -> DataFrame:
    """Whole seconds of each day with a connection open, less host sleep."""
    one = F.lit(0).alias("host")
    joined = join_continued_spans(spans).select(one, "start_wall_ns", "end_wall_ns")
    covered = union_intervals(joined, ["host"])
    asleep = union_intervals(sleeps.select(one, "start_wall_ns", "end_wall_ns"), ["host"])
    days = clip_to_days(covered)
    nights = clip_to_days(asleep)
    total = covered_ns(days, ["day"])
    lost = overlap_ns(days, nights, ["day"])
    recording = F.col("covered_ns") - F.coalesce("overlap_ns", F.lit(0))
    recorded = floor_div(recording, NS_PER_S)
    return total.join(lost, "day", "left").select(
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).cast("string").alias("dt"),
        recorded.alias("seconds_recording"), F.lit(SECONDS_PER_DAY).alias("seconds_in_day"),
        F.struct(recorded.alias("num"), F.lit(SECONDS_PER_DAY).cast("bigint").alias("den")).alias("ratio"),
    )


# ---------------------------------------------------------------- gaps and book time


def book_messages(classified: DataFrame) -> DataFrame:
    """Stored book frames as ``(segment, ticker, sid, ordinal, wall, image)``."""
    rows = classified.where(
        (F.col("outcome") == "baked") & F.col("key").isin("orderbook_delta", "orderbook_snapshot")
    )
    return rows.select(
        "hour_label", "segment", F.col("frame.msg.market_ticker").alias("ticker"),
        F.col("frame.sid").alias("sid"), "ordinal", F.col("recv_wall_ns").alias("wall"),
        (F.col("key") == "orderbook_snapshot").alias("image"),
    )


def _leave_requests(classified: DataFrame, messages: DataFrame) -> DataFrame:
    """Commands that may take a market off its subscription, one row per market."""
    p = F.col("cmd.params")
    good = classified.where((F.col("kind") == 2) & (F.col("outcome") == "not_baked"))
    base = ["segment", "ordinal", F.col("recv_wall_ns").alias("wall")]
    deleted = good.where(
        (F.col("cmd.cmd") == "update_subscription") & p["sid"].isNotNull()
        & (p["action"] == "delete_markets")
    ).select(
        *base, F.explode(p["market_tickers"]).alias("ticker"), F.lit(None).cast("int").alias("retired")
    )
    retired = good.where(F.col("cmd.cmd") == "unsubscribe").select(
        *base, F.explode(p["sids"]).alias("retired")
    )
    followers = messages.select("segment", F.col("sid").alias("retired"), "ticker").distinct()
    return deleted.unionByName(retired.join(followers, ["segment", "retired"]))


_STINT_SCHEMA = (
    "segment string, ticker string, sid int, from_ordinal bigint, from_wall bigint, "
    "to_ordinal bigint, to_wall bigint"
)
_FAR = (1 << 62) + 0


def _walk_stints(keys: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """Stretches a market was followed, from its first message after each leaving command."""
    segment, ticker = keys
    out, sid, since, since_wall = [], None, 0, 0
    for ordinal, wall, leaving, number in rows.sort_values("ordinal")[
        ["ordinal", "wall", "leaving", "number"]
    ].itertuples(index=False):
        if not leaving:
            if sid is None:
                sid, since, since_wall = number, ordinal, wall
        elif sid is not None and number in (-1, sid):
            out.append((segment, ticker, sid, since, since_wall, ordinal, wall))
            sid = None
    if sid is not None:
        out.append((segment, ticker, sid, since, since_wall, _FAR, 0))
    columns = [c.split()[0] for c in _STINT_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=columns)


def market_stints(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """When each market was followed in each segment, and on which subscription.

    Only a market's first message after each leaving command is walked, so the walked rows are as
    few as the commands.
    """
    messages = book_messages(classified)
    leaves = _leave_requests(classified, messages)
    key = ["segment", "ticker"]
    left_once = leaves.select(*key).distinct()
    # Most markets are never told to leave: one stint from their first message to the end.
    first = F.min_by(F.struct("sid", "wall"), "ordinal")
    plain = (
        messages.groupBy(*key)
        .agg(F.min("ordinal").alias("from_ordinal"), first.alias("f"))
        .join(left_once, key, "left_anti")
        .select(
            *key, F.col("f.sid").alias("sid"), "from_ordinal", F.col("f.wall").alias("from_wall"),
            F.lit(_FAR).alias("to_ordinal"), F.lit(0).cast("bigint").alias("to_wall"),
        )
    )
    marked = messages.join(left_once, key, "left_semi").select(
        "segment", "ticker", "ordinal", "wall", F.lit(False).alias("leaving"),
        F.col("sid").alias("number"),
    ).unionByName(
        leaves.select(
            "segment", "ticker", "ordinal", "wall", F.lit(True).alias("leaving"),
            F.coalesce("retired", F.lit(-1)).alias("number"),
        )
    )
    marked = marked.withColumn("block", floor_div("ordinal", ORDINAL_BLOCK))
    gone = F.when(F.col("leaving"), 1).otherwise(0)
    numbered = running(marked, key, ["block"], ["ordinal"], {"leaves": Running("sum", gone)})
    firsts = (
        numbered.where(~F.col("leaving"))
        .groupBy(*key, "leaves")
        .agg(F.min(F.struct("ordinal", "wall", "leaving", "number")).alias("r"))
        .select(*key, "r.*")
    )
    few = firsts.unionByName(
        numbered.where("leaving").select(*key, "ordinal", "wall", "leaving", "number")
    )
    walked = few.groupBy(*key).applyInPandas(_walk_stints, _STINT_SCHEMA)
    stints = plain.unionByName(walked)
    ends = facts.select("segment", "hour_label", F.col("last_recv_wall_ns").alias("last_wall"))
    open_end = F.col("to_ordinal") == _FAR
    return stints.join(ends, "segment").withColumn(
        "to_wall", F.when(open_end, F.col("last_wall")).otherwise(F.col("to_wall"))
    ).drop("last_wall")


def _gap_marks(classified: DataFrame) -> DataFrame:
    rows = classified.where((F.col("outcome") == "baked") & (F.col("key") == "gap"))
    return rows.select(
        "hour_label", "segment", "ordinal", F.col("recv_wall_ns").alias("wall"), "recv_mono_ns",
        "conn_id", F.col("gap.sid").alias("sid"), F.col("gap.expected_seq").alias("expected_seq"),
        F.col("gap.got_seq").alias("got_seq"),
    )


def _block(ordinal: str | Column) -> Column:
    return floor_div(ordinal, ORDINAL_BLOCK)


_MOST_GAPS = 1 << 31  # of one subscription in one segment


def _resolved(gaps: DataFrame, stints: DataFrame, images: DataFrame) -> DataFrame:
    """segment, gap_at, resolved of every gap that some market waits for.

    A market's stint falls into spans, from its begin or an image to the next image or its end, within which
    every gap waits for the same image. There is one span for each stint and image, however many gaps and
    markets there are. The gaps of a subscription are numbered, a span becomes the numbers of the gaps inside it
    (most have none), and these are cut into dyadic blocks, of which each keeps its latest image; a gap takes the
    latest of the blocks it lies in.
    """
    here, key = ["segment", "sid"], ["segment", "sid", "ticker"]
    known = F.col("sid").isNotNull() & F.col("ticker").isNotNull()
    # Each as-of join reads its rows twice, so what goes into one is written.
    stints = materialize(stints.where(known).select(*key, "from_ordinal", "to_ordinal"), "stints")
    images = materialize(images.where(known).select(*key, "ordinal", "wall"), "images")
    followed = asof_join(
        images.select(*key, "ordinal"), stints, key, F.col("ordinal"), F.col("from_ordinal"),
        _block("ordinal"), _block("from_ordinal"), ["to_ordinal"],
    ).where(F.col("ordinal") < F.col("to_ordinal"))
    begins = stints.select(*key, F.col("from_ordinal").alias("at"), "to_ordinal")
    begins = materialize(begins.unionByName(followed.select(*key, F.col("ordinal").alias("at"), "to_ordinal")), "begins")
    spans = asof_join(
        begins, images, key, F.col("at"), F.col("ordinal"), _block("at"), _block("ordinal"), ["wall"],
        forward=True, allow_equal=False,
    )
    end = F.least("to_ordinal", F.coalesce("found_at", F.lit(_FAR)))
    spans = spans.select(*here, "at", end.alias("end"), F.col("found_at").alias("image"), "wall")
    marks = gaps.where(F.col("sid").isNotNull()).select(*here, "ordinal", _block("ordinal").alias("block"))
    marks = materialize(running(marks, here, ["block"], ["ordinal"], {"number": Running("sum", F.lit(1))}), "gaps")
    for edge, name in (("at", "first"), ("end", "after")):
        spans = asof_join(
            materialize(spans, "spans"), marks, here, F.col(edge), F.col("ordinal"), _block(edge), F.col("block"), ["number"], allow_equal=False
        )
        spans = spans.withColumn(name, F.coalesce("number", F.lit(0))).drop("found_at", "number")
    # Gaps are numbered from 1: those inside have numbers from first + 1 to after.
    spans = spans.where(F.col("first") < F.col("after"))
    inside = spans.select(*here, "image", "wall", F.inline(dyadic_blocks("first", "after", "after")))
    blocks = inside.groupBy(*here, "level", F.col("block").alias("of")).agg(
        F.max(F.struct("image", "wall")).alias("latest"), F.max(F.col("image").isNull()).alias("never")
    )
    # Stretches of any length may lie around a gap.
    levels = F.transform(dyadic_levels(F.lit(_MOST_GAPS)), lambda h: F.struct(h.alias("level"), dyadic_block(F.col("number") - 1, h).alias("of")))
    asked = marks.select(*here, F.col("ordinal").alias("gap_at"), F.inline(levels))
    met = asked.join(blocks, [*here, "level", "of"]).groupBy("segment", "gap_at").agg(
        F.max("latest").alias("latest"), F.max("never").alias("never")
    )
    return met.select("segment", "gap_at", F.when(~F.col("never"), F.col("latest.wall")).alias("resolved"))


def gap_rows(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """Gap records with the time the last book they staled was imaged again.

    A gap waits for every market followed on its subscription at that moment. It is resolved when
    the last of them gets its next image on that subscription; with none waiting, or one never
    imaged again, it stays unresolved. See :func:`_resolved` for how the two are brought together.
    """
    gaps = _gap_marks(classified)
    resolved = _resolved(gaps, market_stints(classified, facts), book_messages(classified).where("image"))
    return gaps.join(
        resolved.withColumnRenamed("gap_at", "ordinal"), ["segment", "ordinal"], "left"
    ).select(
        F.col("conn_id").cast("short").alias("conn_id"), "sid", F.col("wall").alias("recv_wall_ns"),
        "recv_mono_ns", "expected_seq", "got_seq",
        F.col("resolved").alias("resolved_recv_wall_ns"), "segment", "ordinal", "hour_label",
    )


def gap_facts(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """Per hour: gaps, market time observed and market time stale because of gaps."""
    stints = market_stints(classified, facts)
    observed = stints.groupBy("hour_label").agg(
        F.sum(F.greatest(F.lit(0), F.col("to_wall") - F.col("from_wall"))).alias("observed_market_ns")
    )
    # A stint is cut at the market's images; a piece is stale from its first gap to its end.
    images = book_messages(classified).where("image")
    inside = (
        stints.join(
            images.select("segment", "ticker", F.col("ordinal").alias("cut"), F.col("wall").alias("cut_wall")),
            ["segment", "ticker"],
        )
        .where((F.col("from_ordinal") <= F.col("cut")) & (F.col("cut") < F.col("to_ordinal")))
        .select("hour_label", "segment", "ticker", "sid", "from_ordinal", "to_ordinal", "to_wall", "cut", "cut_wall")
    )
    starts = stints.select(
        "hour_label", "segment", "ticker", "sid", "from_ordinal", "to_ordinal", "to_wall",
        F.col("from_ordinal").alias("cut"), F.col("from_wall").alias("cut_wall"),
    )
    pieces = starts.unionByName(inside).dropDuplicates(["segment", "ticker", "from_ordinal", "cut"])
    pieces = pieces.withColumn("block", _block("cut"))
    nxt = Window.partitionBy("segment", "ticker", "from_ordinal").orderBy("cut")
    pieces = pieces.select(
        "hour_label", "segment", "sid", "cut",
        F.coalesce(F.lead("cut").over(nxt), "to_ordinal").alias("until"),
        F.coalesce(F.lead("cut_wall").over(nxt), "to_wall").alias("until_wall"),
    )
    gaps = _gap_marks(classified)
    hit = asof_join(
        pieces, gaps, ["segment", "sid"], F.col("cut"), F.col("ordinal"), _block("cut"),
        _block("ordinal"), ["wall"], forward=True, allow_equal=False,
    ).where(F.col("found_at").isNotNull() & (F.col("found_at") < F.col("until")))
    stale = hit.groupBy("hour_label").agg(
        F.sum(F.greatest(F.lit(0), F.col("until_wall") - F.col("wall"))).alias("stale_market_ns")
    )
    counted = gaps.groupBy("hour_label").agg(F.count(F.lit(1)).alias("gaps"))
    zero = F.lit(0).cast("bigint")
    hours = facts.select("hour_label").distinct()
    return hours.join(counted, "hour_label", "left").join(stale, "hour_label", "left").join(
        observed, "hour_label", "left"
    ).select(
        "hour_label", F.coalesce("gaps", zero).alias("gaps"),
        F.coalesce("stale_market_ns", zero).alias("stale_market_ns"),
        F.coalesce("observed_market_ns", zero).alias("observed_market_ns"),
    )


# ---------------------------------------------------------------- summaries


def ratio(num: Column, den: Column) -> Column:
    """An exact ratio; ``(0, 0)`` means no data and must not be divided."""
    return F.struct(num.cast("bigint").alias("num"), den.cast("bigint").alias("den"))


def audit_summary(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Audits by outcome with exact and consistency ratios; undecidable ones are in neither."""
    outcome = F.col("outcome")
    count = lambda name: F.count(F.when(outcome == name, 1))
    exact, consistent, inconsistent = count("exact"), count("consistent"), count("inconsistent")
    sampled = exact + consistent + inconsistent
    mismatched = F.sum(F.when(outcome != "undecidable", F.coalesce("mismatched_levels", F.lit(0))))
    return audits.groupBy(*keys).agg(
        sampled.alias("books_sampled"), exact.alias("books_exact"),
        consistent.alias("books_consistent"), inconsistent.alias("books_inconsistent"),
        count("undecidable").alias("books_undecidable"),
        F.coalesce(mismatched, F.lit(0)).cast("bigint").alias("levels_mismatched"),
        ratio(exact, sampled).alias("exact_ratio"),
        ratio(exact + consistent, sampled).alias("consistency_ratio"),
    )


def gap_summary(hours: DataFrame) -> DataFrame:
    """Per day: gaps and the share of market time they cost; floors come after the sums."""
    affected = floor_div(F.sum("stale_market_ns"), NS_PER_S)
    observed = floor_div(F.sum("observed_market_ns"), NS_PER_S)
    return hours.groupBy(F.substring("hour_label", 1, 10).alias("dt")).agg(
        F.sum("gaps").alias("count"), affected.alias("market_seconds_affected"),
        observed.alias("market_seconds_observed"), ratio(affected, observed).alias("share"),
    )


def connection_status(records: DataFrame, gaps: DataFrame, stale_books: DataFrame | None = None) -> DataFrame:
    """Frames, gaps, reconnections and stale books per connection."""
    frames = records.groupBy("conn_id").agg(
        F.count(F.when(F.col("kind") == 1, 1)).alias("frames"),
        F.count(F.when(F.col("event") == "open", 1)).alias("opens"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("sink_dropped"),
    )
    holes = gaps.groupBy("conn_id").agg(F.count(F.lit(1)).alias("gaps"))
    out = frames.join(holes, "conn_id", "left")
    if stale_books is not None:
        out = out.join(stale_books, "conn_id", "left")
    else:
        out = out.withColumn("stale_books", F.lit(0).cast("bigint"))
    zero = F.lit(0)
    return out.select(
        "conn_id", "frames", F.coalesce("gaps", zero).alias("gaps"),
        F.greatest(zero, F.col("opens") - 1).alias("reconnects"),
        F.coalesce("stale_books", zero).alias("stale_books"), "sink_dropped",
    )


def green_days(metrics: DataFrame, targets: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """Days on which every ratio meets its target, and how many per month.

    Targets map a ratio column to ``(num, den, at_least)``; comparison is by cross-multiplication.
    """
    meets = F.lit(True)
    for column, (num, den, at_least) in targets.items():
        left = F.col(f"{column}.num").cast("decimal(38,0)") * den
        right = F.col(f"{column}.den").cast("decimal(38,0)") * num
        meets = meets & (F.col(f"{column}.den") > 0) & ((left >= right) if at_least else (left <= right))
    days = metrics.groupBy("dt").agg(F.bool_and(F.coalesce(meets, F.lit(False))).alias("green"))
    return days.withColumn("month", F.substring("dt", 1, 7)).groupBy("month").agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("green"), 1)).alias("green_days")
    )


__all__ = [
    "audit_summary", "book_messages", "clock_jumps", "connection_spans",
    "connection_status", "gap_facts", "gap_rows", "gap_summary", "green_days", "host_sleeps",
    "join_continued_spans", "market_stints", "overflow_dropped", "ratio", "uptime",
]
