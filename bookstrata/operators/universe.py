"""Choose the markets to record by ranked rule groups.

The only loop is over the policy's groups. Within a group all markets are ranked in parallel; what
a group chooses is bounded by its own caps, so the chosen sets are small whatever the listing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.exact import PRICE_SCALE
from bookstrata.functions.markets import ACTIVE_STATUS, THRESHOLD_STRIKES, yes_mid
from bookstrata.operators.directory import as_last_reported
from bookstrata.session import materialize

# Every reason a listed market is not recorded, in the order selection applies them.
REASONS = (
    "duplicate", "not_active", "mve", "closed", "beyond_horizon", "no_group",
    "event_beyond_horizon", "below_volume", "event_not_chosen", "over_markets_per_event",
    "over_max_markets", "over_cap",
)


@dataclass(frozen=True)
class Group:
    """One rule: which events it admits and how many markets of each."""

    name: str
    events: int
    markets_per_event: int
    series: tuple[str, ...] | None = None
    category: str | None = None
    max_markets: int | None = None
    max_hours_to_close: int | None = None
    market_order: str = "volume"

    def __post_init__(self) -> None:
        if not self.name or (self.series is None) == (self.category is None):
            raise ValueError(f"group {self.name!r} needs a name and exactly one selector")
        if self.series is not None and (
            not self.series or not all(self.series) or len(set(self.series)) < len(self.series)
        ):
            raise ValueError(f"group {self.name!r}: series must be non-empty and distinct")
        if self.category == "" or self.market_order not in ("volume", "near_price"):
            raise ValueError(f"group {self.name!r}: bad category or market_order")
        caps = (self.events, self.markets_per_event, self.max_markets, self.max_hours_to_close)
        if any(c is not None and c <= 0 for c in caps):
            raise ValueError(f"group {self.name!r}: counts and horizons must be positive")


@dataclass(frozen=True)
class Policy:
    """The rules, the volume floor of category groups and the overall budget."""

    min_volume_24h: int
    max_markets: int
    groups: tuple[Group, ...]
    exclude_mve: bool = True
    max_seconds_to_close: int | None = None

    def __post_init__(self) -> None:
        names = [g.name for g in self.groups]
        bad_horizon = self.max_seconds_to_close is not None and self.max_seconds_to_close <= 0
        if self.min_volume_24h < 0 or self.max_markets < 0 or bad_horizon:
            raise ValueError("floor, budget and horizon must not be negative")
        if len(set(names)) < len(names):
            raise ValueError("group names must be unique")


@dataclass(frozen=True)
class Decision:
    """What was chosen and why the rest was not."""

    chosen: DataFrame
    reasons: DataFrame
    duplicates: DataFrame
    policy: Policy = field(repr=False)

    def admitted(self) -> DataFrame:
        """Chosen markets within the budget."""
        return self.chosen.where("admitted")

    def reason_counts(self) -> DataFrame:
        """Count per reason, zeros included."""
        over = self.chosen.where(~F.col("admitted")).select(F.lit("over_cap").alias("reason"))
        counted = (
            self.reasons.select("reason")
            .unionByName(over)
            .groupBy("reason")
            .agg(F.count(F.lit(1)).alias("markets"))
            .unionByName(
                self.duplicates.agg(
                    F.lit("duplicate").alias("reason"),
                    F.coalesce(F.sum("extra"), F.lit(0)).alias("markets"),
                )
            )
        )
        spark = self.chosen.sparkSession
        every = spark.createDataFrame([(r, i) for i, r in enumerate(REASONS)], "reason string, rank int")
        return every.join(counted, "reason", "left").select(
            "reason", "rank", F.coalesce("markets", F.lit(0)).alias("markets")
        )

    def group_counts(self) -> DataFrame:
        """Admitted markets, events and markets skipped for budget, per group, zeros included."""
        spark = self.chosen.sparkSession
        rows = [(g.name, i) for i, g in enumerate(self.policy.groups)]
        every = spark.createDataFrame(rows, "group string, group_no int")
        event = F.when(F.col("admitted"), F.struct("series_ticker", "event_ticker"))
        counted = self.chosen.groupBy("group").agg(
            F.count(F.when(F.col("admitted"), 1)).alias("admitted"),
            F.countDistinct(event).alias("events"),
            F.count(F.when(~F.col("admitted"), 1)).alias("skipped_for_budget"),
        )
        zero = F.lit(0)
        return every.join(counted, "group", "left").select(
            "group", "group_no", F.coalesce("admitted", zero).alias("admitted"),
            F.coalesce("events", zero).alias("events"),
            F.coalesce("skipped_for_budget", zero).alias("skipped_for_budget"),
        )


def _freshness() -> Column:
    """Total order that picks one copy of a ticker listed twice: larger volume first."""
    minus, blank = F.lit(-1), F.lit("")
    return F.struct(
        F.col("volume_24h"), F.coalesce("close_ts", minus.cast("bigint")).alias("k1"),
        F.col("status"), F.col("event_ticker"), F.col("series_ticker"), F.col("exchange_index"),
        F.col("is_mve"), F.coalesce("strike_type", blank).alias("k7"),
        F.coalesce("yes_bid", minus).alias("k8"), F.coalesce("yes_ask", minus).alias("k9"),
        F.coalesce("last_price", minus).alias("k10"),
    )


def dedupe_listing(listing: DataFrame) -> DataFrame:
    """One copy of each ticker, with the number of extra copies in ``extra``."""
    rest = [c for c in listing.columns if c != "ticker"]
    return listing.groupBy("ticker").agg(
        F.max_by(F.struct(*rest), _freshness()).alias("m"),
        (F.count(F.lit(1)) - 1).alias("extra"),
    ).select("ticker", "m.*", "extra")


def rejection(policy: Policy, now_ts: int) -> Column:
    """First reason a market is not eligible, or NULL. An unknown close passes both time rules."""
    close, now = F.col("close_ts"), F.lit(now_ts)
    chain = F.when(F.col("status") != ACTIVE_STATUS, "not_active")
    if policy.exclude_mve:
        chain = chain.when(F.col("is_mve"), "mve")
    chain = chain.when(close <= now, "closed")
    if policy.max_seconds_to_close is not None:
        chain = chain.when(close - now > policy.max_seconds_to_close, "beyond_horizon")
    return chain


def event_totals(markets: DataFrame) -> DataFrame:
    """Volume, earliest known close and whether all strikes are thresholds, per event."""
    threshold = F.coalesce(F.col("strike_type").isin(*THRESHOLD_STRIKES), F.lit(False))
    return markets.groupBy("series_ticker", "event_ticker").agg(
        F.sum("volume_24h").alias("event_volume"), F.min("close_ts").alias("event_close"),
        F.bool_and(threshold).alias("all_thresholds"),
    )


def _market_order(group: Group) -> list[Column]:
    volume = [F.col("volume_24h").desc(), F.col("close_ts").asc_nulls_last(), F.col("ticker").asc()]
    if group.market_order == "volume":
        return volume
    mid = yes_mid("yes_bid", "yes_ask", "last_price")
    half = F.abs(mid - PRICE_SCALE // 2)
    distance = F.when(F.col("all_thresholds"), half).otherwise(F.lit(PRICE_SCALE) - mid)
    return [distance.asc_nulls_last(), *volume]


def _group_choice(group: Group, number: int, cands: DataFrame, floor: int, now_ts: int) -> tuple[DataFrame, DataFrame]:
    """What one group chooses, in its order, and why it passes over the other candidates."""
    key = ["series_ticker", "event_ticker"]
    events = event_totals(cands)
    reason = F.lit(None).cast("string")
    if group.series is None:
        reason = F.when(F.col("event_volume") < floor, "below_volume")
    if group.max_hours_to_close is not None:
        latest = F.lit(now_ts + group.max_hours_to_close * 3_600)
        late = F.col("event_close").isNull() | (F.col("event_close") > latest)
        reason = F.when(late, "event_beyond_horizon").otherwise(reason)
    events = events.withColumn("event_reason", reason)
    able = events.where(F.col("event_reason").isNull())
    close = F.col("event_close").asc_nulls_last()
    if group.series is not None:
        nearest = Window.partitionBy("series_ticker").orderBy(close, "event_ticker")
        listed = F.array_position(F.array(*[F.lit(s) for s in group.series]), F.col("series_ticker"))
        picked = (
            able.withColumn("nth", F.row_number().over(nearest))
            .where(F.col("nth") <= group.events)
            .withColumn("event_pos", F.struct(listed.cast("bigint"), F.col("nth").cast("bigint")))
        )
    else:
        ranking = [F.col("event_volume").desc(), close, F.col("event_ticker"), F.col("series_ticker")]
        top = able.orderBy(*ranking).limit(group.events)
        # At most ``events`` rows are left to number.
        nth = F.row_number().over(Window.orderBy(*ranking)).cast("bigint")
        picked = top.withColumn("event_pos", F.struct(F.lit(0).cast("bigint"), nth))
    picked = picked.select(*key, "event_pos", "all_thresholds")
    in_event = Window.partitionBy(*key).orderBy(*_market_order(group))
    best = (
        cands.join(picked, key)
        .withColumn("nth", F.row_number().over(in_event))
        .where(F.col("nth") <= group.markets_per_event)
    )
    # Bounded by events x markets_per_event (x series), so one task can number it.
    order = F.row_number().over(Window.orderBy("event_pos", "nth"))
    best = materialize(
        best.select("ticker", *key, order.alias("pos")).withColumn("group_no", F.lit(number)), "chosen"
    )
    capped = F.lit(True) if group.max_markets is None else F.col("pos") <= group.max_markets
    why = F.coalesce(
        "event_reason",
        F.when(F.col("event_pos").isNull(), "event_not_chosen")
        .when(F.col("pos").isNull(), "over_markets_per_event")
        .when(~capped, "over_max_markets"),
    )
    reasons = (
        cands.select("ticker", *key)
        .join(events.select(*key, "event_reason"), key)
        .join(picked.select(*key, "event_pos"), key, "left")
        .join(best.select("ticker", "pos"), "ticker", "left")
        .select("ticker", F.lit(number).alias("group_no"), why.alias("reason"))
        .where(F.col("reason").isNotNull())
    )
    return best.where(capped), reasons


def select(
    listing: DataFrame,
    policy: Policy,
    now_ts: int,
    categories: DataFrame | None = None,
    pinned: DataFrame | Mapping[str, Sequence[str]] | None = None,
) -> Decision:
    """Choose the markets to record.

    Args:
        listing: Listed markets, possibly with repeated tickers.
        policy: The rules.
        now_ts: Unix seconds of the decision.
        categories: ``(series_ticker, category)``; series missing from it match no category group.
        pinned: Markets a group keeps from an earlier decision instead of choosing again: lists by
            group, or a table ``(group, ticker, pos)`` that pins every group.
    """
    spark = listing.sparkSession
    markets = dedupe_listing(listing).withColumn("reason", rejection(policy, now_ts))
    if categories is not None:
        markets = markets.join(categories.select("series_ticker", "category"), "series_ticker", "left")
    else:
        markets = markets.withColumn("category", F.lit(None).cast("string"))
    markets = materialize(markets, "markets")
    eligible = markets.where(F.col("reason").isNull()).drop("reason", "extra")
    chosen: DataFrame | None = None
    passed: DataFrame | None = None
    for number, group in enumerate(policy.groups):
        left = eligible if chosen is None else eligible.join(chosen.select("ticker"), "ticker", "left_anti")
        pins = None
        if isinstance(pinned, DataFrame):
            pins = pinned.where(F.col("group") == group.name).groupBy("ticker").agg(F.min("pos").alias("pos"))
        elif pinned is not None and group.name in pinned:
            held = dict.fromkeys(pinned[group.name])
            pins = spark.createDataFrame([(t, i) for i, t in enumerate(held)], "ticker string, pos int")
        if pins is not None:
            mine = left.join(pins, "ticker").select(
                "ticker", "series_ticker", "event_ticker", "pos", F.lit(number).alias("group_no")
            )
            mine, reasons = materialize(mine, "pinned"), None
        else:
            if group.series is not None:
                cands = left.where(F.col("series_ticker").isin(*group.series))
            else:
                cands = left.where(F.col("category") == group.category)
            mine, reasons = _group_choice(group, number, cands, policy.min_volume_24h, now_ts)
        mine = mine.withColumn("group", F.lit(group.name)).withColumn(
            "showcase", F.lit(group.series is not None)
        )
        chosen = mine if chosen is None else chosen.unionByName(mine)
        if reasons is not None:
            passed = reasons if passed is None else passed.unionByName(reasons)
    if chosen is None:
        chosen = eligible.where(F.lit(False)).select(
            "ticker", "series_ticker", "event_ticker", F.lit(0).alias("pos"),
            F.lit(0).alias("group_no"), F.lit("").alias("group"), F.lit(False).alias("showcase"),
        )
    # Groups fill the budget in order, so the budget is a rank over the bounded chosen set.
    place = F.row_number().over(Window.orderBy("group_no", "pos"))
    chosen = chosen.withColumn("place", place).withColumn("admitted", F.col("place") <= policy.max_markets)
    unchosen = eligible.join(chosen.select("ticker"), "ticker", "left_anti").select("ticker")
    if passed is not None:
        first = passed.groupBy("ticker").agg(F.min_by("reason", "group_no").alias("reason"))
        unchosen = unchosen.join(first, "ticker", "left")
    else:
        unchosen = unchosen.withColumn("reason", F.lit(None).cast("string"))
    reasons = (
        markets.where(F.col("reason").isNotNull())
        .select("ticker", "reason")
        .unionByName(unchosen.select("ticker", F.coalesce("reason", F.lit("no_group")).alias("reason")))
    )
    extras = markets.select("extra")
    return Decision(chosen=chosen, reasons=reasons, duplicates=extras, policy=policy)


def remove_closed(decision: Decision, listing: DataFrame, state: DataFrame, now_ts: int) -> Decision:
    """The decision without markets that closed or ended since, everything else kept as it was.

    ``state`` is the output of :func:`bookstrata.operators.directory.lifecycle_state`.
    """
    admitted = decision.admitted().select("group", "ticker", F.col("place").alias("pos"))
    markets = dedupe_listing(listing).drop("extra").join(admitted.select("ticker"), "ticker", "left_semi")
    return select(as_last_reported(markets, state), decision.policy, now_ts, pinned=admitted)


def series_per_category(categories: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Series known per wanted category, zeros included."""
    every = categories.sparkSession.createDataFrame([(c,) for c in wanted], "category string")
    counts = categories.groupBy("category").agg(F.count(F.lit(1)).alias("series"))
    return every.join(counts, "category", "left").select(
        "category", F.coalesce("series", F.lit(0)).alias("series")
    )


def absent_series(listing: DataFrame, policy: Policy) -> DataFrame:
    """Series named by a group that no listed market belongs to."""
    names = sorted({s for g in policy.groups for s in g.series or ()})
    asked = listing.sparkSession.createDataFrame([(s,) for s in names], "series_ticker string")
    return asked.join(listing.select("series_ticker").distinct(), "series_ticker", "left_anti")


def membership_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Tickers added to and removed from each group between two assignments ``(group, ticker)``."""
    key = ["group", "ticker"]
    both = (
        current.select(*key).distinct().withColumn("was", F.lit(True))
        .join(desired.select(*key).distinct().withColumn("is", F.lit(True)), key, "full")
    )
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
    return both.select(*key, change.alias("change")).where(F.col("change").isNotNull())


def rebuilt_groups(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Groups of both assignments ``(group, ticker, conn_id)`` that cannot be updated in place, and why.

    A subscription stays on its connection and is never without a market, so a group is rebuilt if its
    connection changes or none of its members stays.
    """
    was = current.groupBy("group").agg(F.min("conn_id").alias("from_conn"))
    now = desired.groupBy("group").agg(F.min("conn_id").alias("to_conn"))
    key = ["group", "ticker"]
    stay = current.select(*key).distinct().join(desired.select(*key), key, "left_semi").groupBy("group").agg(F.count(F.lit(1)).alias("staying"))
    moved, replaced = F.col("from_conn") != F.col("to_conn"), F.col("staying").isNull()
    why = F.when(moved & replaced, "moved and replaced").when(moved, "moved").when(replaced, "replaced")
    return was.join(now, "group").join(stay, "group", "left").select("group", why.alias("why")).where(F.col("why").isNotNull())


def unpriced_events(decision: Decision, listing: DataFrame) -> DataFrame:
    """Events a near-price series group admitted with a market that has no price yet."""
    names = [
        g.name for g in decision.policy.groups if g.series is not None and g.market_order == "near_price"
    ]
    mid = yes_mid("yes_bid", "yes_ask", "last_price")
    priced = dedupe_listing(listing).select("ticker", mid.alias("mid"))
    held = decision.admitted().where(F.col("group").isin(*names) if names else F.lit(False))
    return held.join(priced, "ticker").where(F.col("mid").isNull()).groupBy("group", "event_ticker").agg(
        F.count(F.lit(1)).alias("unpriced")
    )


def rotation(tickers: DataFrame, count: int, cursor: int) -> DataFrame:
    """The next ``count`` distinct tickers of a sorted rotation starting at ``cursor``.

    Ranks come from a range partitioning: each task numbers its own range and adds the sizes of the
    ranges before it, so the sorted list is never gathered in one task.
    """
    if count < 0:
        raise ValueError("count must be non-negative")
    ordered = tickers.select("ticker").distinct().sort("ticker")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()), "rotation")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range, a few hundred at most.
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    total = F.sum("n").over(Window.partitionBy())
    offsets = sizes.select("part", before.alias("before"), total.alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("ticker"))
    ranked = ordered.withColumn("in_part", place).join(F.broadcast(offsets), "part")
    index = F.col("before") + F.col("in_part") - 1
    away = F.pmod(index - F.pmod(F.lit(cursor), F.col("total")), F.col("total"))
    take = F.least(F.lit(count).cast("bigint"), F.col("total"))
    return ranked.select("ticker", away.alias("nth"), "total", take.alias("take")).where(
        F.col("nth") < F.col("take")
    ).select(
        "ticker", "nth",
        F.pmod(F.pmod(F.lit(cursor), F.col("total")) + F.col("take"), F.col("total")).alias("next_cursor"),
    )
