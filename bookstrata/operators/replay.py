"""Set-based order-book replay.

A book is rebuilt from images and later changes without walking a market's rows one after another
in one task. The rules (from the data model): a valid image replaces the book and makes it fresh; a
change on a stale book is ignored; a change that would make a level negative leaves the levels
alone and stales the book; a change that crosses the book is applied and then stales it; an invalid
image stales the book and keeps its levels; a gap stales every book whose latest change came from
the gap's subscription.

The shape of the job:

* All rows are sorted once by market and full position, and a row's rank among them all tells its
  *slice* of ``slice_rows`` consecutive rows. All heavy steps are keyed by (market, slice), so a
  market holding a third of all rows spreads over as many tasks as it has slices, also where all of
  them fall into one minute or one reading of the clock. Only a slice's first and last market reach
  beyond it, so what is carried from slice to slice is looked up in a small table.
* An *epoch* runs from one valid image to the next. Level counts are running sums within an epoch.
* The *cut* of an epoch is its first violation. Sums past the cut are wrong but never used, so all
  violations can be found independently and the earliest wins.
* Best prices come from the stretches during which levels rest. A slice's changes are numbered, a
  stretch is cut into blocks of powers of two, and a change's best price is the best of the blocks
  it lies in, one of each size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.exact import floor_div
from bookstrata.operators.ordering import numbered, restart_boundaries, with_stretch
from bookstrata.operators.running import asof_join, dyadic_block, dyadic_blocks, dyadic_levels
from bookstrata.session import materialize

BID, ASK, EMPTY = 0, 1, -1
SLICE_ROWS = 4_096

_LEVELS = "array<struct<side:tinyint,price_e4:int,count_e2:bigint>>"
_CHANGE_COLUMNS = [
    "ticker", "src", "wall", "mono", "conn_id", "sid", "seq", "ts_ms", "side", "price_e4",
    "delta_e2", "levels", "valid", "base_stale",
]


@dataclass(frozen=True)
class Books:
    """Books at one instant: resting levels, and one status row per market."""

    levels: DataFrame
    status: DataFrame


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def snapshot_images(snapshots: DataFrame) -> DataFrame:
    """One row per image from rows sharing its receipt and sequence, with its validity.

    Rows are first counted per price, so the array built per image holds each price once and is
    bounded by the price grid whatever the input.
    """
    keys = ["ticker", "recv_wall_ns", "conn_id", "sid", "seq"]
    level = F.col("side").isin(BID, ASK)
    per_price = snapshots.groupBy(*keys, "side", "price_e4").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("count_e2").alias("count_e2"),
        F.min("recv_mono_ns").alias("recv_mono_ns"),
    )
    image = per_price.groupBy(*keys).agg(
        F.min("recv_mono_ns").alias("recv_mono_ns"),
        F.collect_list(F.when(level, F.struct("side", "price_e4", "count_e2"))).alias("levels"),
        F.max(F.when(level & (F.col("n") > 1), 1).otherwise(0)).alias("repeated"),
        F.min(F.when(level, F.col("count_e2"))).alias("least"),
        F.max(F.when(F.col("side") == BID, F.col("price_e4"))).alias("bid"),
        F.min(F.when(F.col("side") == ASK, F.col("price_e4"))).alias("ask"),
    )
    valid = (
        (F.col("repeated") == 0)
        & F.coalesce(F.col("least") > 0, F.lit(True))
        & F.coalesce(F.col("bid") < F.col("ask"), F.lit(True))
    )
    return image.select(*keys, "recv_mono_ns", "levels", valid.alias("valid"))


def keyframe_bases(keyframe: DataFrame) -> DataFrame:
    """One row per market of a keyframe: its levels, flag and exchange time.

    A keyframe whose levels form no valid book is loaded as stale.
    """
    level = F.col("side").isin(BID, ASK)
    base = keyframe.groupBy("ticker").agg(
        F.collect_list(F.when(level, F.struct("side", "price_e4", "count_e2"))).alias("levels"),
        F.max("stale").alias("stale"),
        F.max("last_ts_ms").alias("last_ts_ms"),
        F.max("as_of_recv_ns").alias("as_of_recv_ns"),
        F.max(F.when(F.col("side") == BID, F.col("price_e4"))).alias("bid"),
        F.min(F.when(F.col("side") == ASK, F.col("price_e4"))).alias("ask"),
    )
    crossed = F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False))
    return base.select(
        "ticker", "levels", (F.col("stale") | crossed).alias("stale"), "last_ts_ms",
        "as_of_recv_ns", crossed.alias("crossed"),
    )


def _delta_rows(deltas: DataFrame) -> DataFrame:
    return deltas.select(
        "ticker",
        F.lit(0).alias("src"),
        F.col("recv_wall_ns").alias("wall"),
        F.col("recv_mono_ns").alias("mono"),
        F.col("conn_id").cast("int").alias("conn_id"),
        "sid",
        "seq",
        "ts_ms",
        F.col("side").cast("int").alias("side"),
        "price_e4",
        "delta_e2",
        _null(_LEVELS).alias("levels"),
        F.lit(True).alias("valid"),
        F.lit(False).alias("base_stale"),
    )


def _image_rows(snapshots: DataFrame) -> DataFrame:
    return snapshot_images(snapshots).select(
        "ticker",
        F.lit(1).alias("src"),
        F.col("recv_wall_ns").alias("wall"),
        F.col("recv_mono_ns").alias("mono"),
        F.col("conn_id").cast("int").alias("conn_id"),
        "sid",
        "seq",
        _null("bigint").alias("ts_ms"),
        _null("int").alias("side"),
        _null("int").alias("price_e4"),
        _null("bigint").alias("delta_e2"),
        F.col("levels").cast(_LEVELS).alias("levels"),
        "valid",
        F.lit(False).alias("base_stale"),
    )


def _base_rows(keyframe: DataFrame) -> DataFrame:
    return keyframe_bases(keyframe).select(
        "ticker",
        F.lit(2).alias("src"),
        F.col("as_of_recv_ns").alias("wall"),
        F.lit(0).cast("bigint").alias("mono"),
        _null("int").alias("conn_id"),
        _null("int").alias("sid"),
        _null("bigint").alias("seq"),
        F.col("last_ts_ms").alias("ts_ms"),
        _null("int").alias("side"),
        _null("int").alias("price_e4"),
        _null("bigint").alias("delta_e2"),
        F.col("levels").cast(_LEVELS).alias("levels"),
        F.lit(True).alias("valid"),
        F.col("stale").alias("base_stale"),
    )


_LAST = (1 << 63) - 1


def _position() -> Column:
    """Total order of one market's changes.

    Boot, monotonic time, then source; ties keep the stored order of the tables, nulls last.
    """
    return F.struct(
        F.col("stretch"),
        F.col("mono"),
        F.col("src"),
        F.coalesce("ts_ms", F.lit(_LAST)).alias("k_ts"),
        F.coalesce("seq", F.lit(_LAST)).alias("k_seq"),
        F.col("wall"),
        F.coalesce("side", F.lit(-1)).alias("k_side"),
        F.coalesce("price_e4", F.lit(-1)).alias("k_price"),
        F.coalesce("delta_e2", F.lit(0)).alias("k_delta"),
    )


def _instant(stretch: Column, mono: Column, src: int) -> Column:
    """A position before (``src=-1``) or after (``src=9``) every change of one reading."""
    zero = F.lit(0).cast("bigint")
    return F.struct(
        stretch.cast("int").alias("stretch"),
        mono.cast("bigint").alias("mono"),
        F.lit(src).alias("src"),
        zero.alias("k_ts"),
        zero.alias("k_seq"),
        zero.alias("wall"),
        F.lit(0).alias("k_side"),
        F.lit(0).alias("k_price"),
        zero.alias("k_delta"),
    )


def ordered_changes(
    deltas: DataFrame,
    snapshots: DataFrame,
    gaps: DataFrame,
    keyframe: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Deltas, images and keyframe bases as one ordered change table, and the ordered gaps.

    Host restarts are found over all three sources together, as receive order needs.
    """
    # Images are read by every pass over the changes: to sample ranges, to lay rows out, to find last images.
    images = materialize(_image_rows(snapshots), "images")
    changes = _delta_rows(deltas).unionByName(images)
    gap_rows = gaps.select(
        F.col("conn_id").cast("int").alias("conn_id"),
        "sid",
        F.col("recv_wall_ns").alias("wall"),
        F.col("recv_mono_ns").alias("mono"),
        F.lit(2).alias("src"),
    )
    readings = (
        deltas.select("recv_wall_ns", "recv_mono_ns", F.lit(0).alias("src"))
        .unionByName(snapshots.select("recv_wall_ns", "recv_mono_ns", F.lit(1).alias("src")))
        .unionByName(gaps.select("recv_wall_ns", "recv_mono_ns", F.lit(2).alias("src")))
    )
    boundaries = restart_boundaries(readings, "recv_wall_ns", "recv_mono_ns", "src")
    changes = with_stretch(changes, boundaries)
    gap_rows = with_stretch(gap_rows, boundaries)
    if keyframe is not None:
        changes = changes.unionByName(
            _base_rows(keyframe).withColumn("stretch", F.lit(-1).cast("int"))
        )
    changes = changes.withColumn("pos", _position())
    return changes, gap_rows


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """``rows`` with their rank among the rows of all markets, sorted by market and position, and their slice."""
    return numbered(rows, ["ticker", "pos"], "changes").withColumn("slice", floor_div("rank", slice_rows).cast("int"))


def _shared_slices(rows: DataFrame) -> DataFrame:
    """Slices of markets that lie in several: the epochs at their start and end, and whether another slice follows.

    Of the markets in a slice only the first and the last reach beyond it, so these are two rows a slice at most.
    """
    images = rows.groupBy("ticker", "slice").agg(F.count(F.when(_starts(), 1)).alias("images"))
    market = Window.partitionBy("ticker").orderBy("slice")
    upto = F.sum("images").over(market.rowsBetween(Window.unboundedPreceding, 0))
    found = images.select(
        "ticker", "slice", (upto - F.col("images")).alias("epoch_in"), upto.alias("epoch_out"),
        F.lag("slice").over(market).isNotNull().alias("follows"), F.lead("slice").over(market).isNotNull().alias("goes_on"),
    )
    return materialize(found.where(F.col("follows") | F.col("goes_on")).drop("follows"), "shared-slices")


def _starts() -> Column:
    """Whether a change starts an epoch."""
    return F.col("valid") & (F.col("src") > 0)


def _level_rows(placed: DataFrame) -> DataFrame:
    """One row per level change of some changes with their shared slices: epoch, and whether it may reach into other slices."""
    walk = Window.partitionBy("ticker", "slice").orderBy("rank")
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    subscription = F.struct("conn_id", "sid")
    within = F.sum(F.when(_starts(), 1).otherwise(0)).over(upto)
    placed = (
        placed.withColumn("epoch", F.coalesce("epoch_in", F.lit(0)) + within)
        .withColumn(
            "run_start",
            _starts()
            | F.coalesce(~F.lag(subscription).over(walk).eqNullSafe(subscription), F.lit(True)),
        )
        .where(F.col("epoch") > 0)
        .withColumn(
            "spans",
            F.coalesce((F.col("epoch") == F.col("epoch_in")) | (F.col("goes_on") & (F.col("epoch") == F.col("epoch_out"))), F.lit(False)),
        )
    )
    level = "struct<side:int,price_e4:int,delta_e2:bigint>"
    marker = F.array(F.lit(None).cast(level))
    single = F.array(F.struct("side", "price_e4", "delta_e2").cast(level))
    kept = F.when(F.col("valid") & (F.size("levels") > 0), F.col("levels")).cast(f"array<{level}>")
    exploded = placed.select(
        "ticker", "slice", "epoch", "rank", "pos", "src", "conn_id", "sid", "ts_ms", "valid",
        "base_stale", "run_start", "wall", "spans",
        F.posexplode(
            F.when(F.col("src") == 0, single).otherwise(F.coalesce(kept, marker))
        ).alias("nth", "level"),
    )
    return exploded.select(
        "ticker", "slice", "epoch", "rank", "pos", "src", "conn_id", "sid", "ts_ms", "valid",
        "base_stale", "wall", "spans",
        (F.col("run_start") & (F.col("nth") == 0)).alias("run_start"),
        F.coalesce("level.side", F.lit(EMPTY)).alias("side"),
        F.coalesce("level.price_e4", F.lit(0)).alias("price_e4"),
        F.coalesce("level.delta_e2", F.lit(0)).cast("bigint").alias("delta_e2"),
    )


def level_log(changes: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every level change with its slice, epoch and running count.

    One row per delta, one per level of an image, and one marker row (``side=-1``) for an empty or
    invalid image. Rows before a market's first valid image are left out: the book is stale then
    and has no levels. The result is written to the shared scratch folder, because cuts, states and
    timelines all read it.

    Changes are shuffled once, by market and slice. Counts are carried from slice to slice only for epochs that may
    reach into several (``spans``), so a market within one slice costs no more than its own rows.
    """
    rows = _sliced(changes, slice_rows)
    shared = _shared_slices(rows)
    key = ["ticker", "slice"]
    level = ["ticker", "epoch", "side", "price_e4"]
    summed = _level_rows(rows.join(shared, key)).where("spans").groupBy(*level, "slice").agg(F.sum("delta_e2").alias("total"))
    earlier = Window.partitionBy(*level).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summed.select(*level, "slice", F.sum("total").over(earlier).alias("carried")).where("carried <> 0")
    carried = materialize(carried, "carried")
    inside = Window.partitionBy(*level, "slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    log = _level_rows(rows.join(shared, key, "left")).withColumn("inside", F.sum("delta_e2").over(inside))
    log = log.join(carried, [*level, "slice"], "left")
    return materialize(log.withColumn("count_e2", F.col("inside") + F.coalesce("carried", F.lit(0))).drop("inside", "carried"), "level-log")


def open_at_slice_start(log: DataFrame) -> DataFrame:
    """Levels resting when each later slice of an epoch starts.

    Slices hold several times as many rows as a book has levels, so repeating the open levels at
    each slice start stays a fraction of the rows themselves.
    """
    log = log.where("spans")
    level = ["ticker", "epoch", "side", "price_e4"]
    closing = (
        log.where(F.col("side") >= 0)
        .groupBy(*level, "slice")
        .agg(F.max_by("count_e2", "rank").alias("count_e2"))
    )
    ends = log.groupBy("ticker", "epoch").agg(F.max("slice").alias("last_slice"))
    upto = F.least(
        F.coalesce(F.lead("slice").over(Window.partitionBy(*level).orderBy("slice")), F.col("last_slice")),
        F.col("last_slice"),
    )
    spans = (
        closing.join(ends, ["ticker", "epoch"])
        .withColumn("upto", upto)
        .where((F.col("count_e2") > 0) & (F.col("upto") > F.col("slice")))
    )
    return spans.select(
        *level,
        "count_e2",
        F.explode(F.sequence(F.col("slice") + 1, F.col("upto"))).alias("slice"),
    )


def _toggles(log: DataFrame) -> DataFrame:
    """Rows at which a level starts or stops resting, and valid images of empty books."""
    after = F.col("count_e2") > 0
    before = (F.col("count_e2") - F.col("delta_e2")) > 0
    emptied = (F.col("side") == EMPTY) & F.col("valid")
    return log.where(((F.col("side") >= 0) & (after != before)) | emptied).withColumn(
        "opened", after
    )


def _slice_quotes(log: DataFrame, carried: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Best bid and ask after every position that opens or closes a level, slice by slice.

    Everything after the one shuffle by slice is keyed by slice and more, so nothing is shuffled again.

    Args:
        log: The level log.
        carried: Levels resting at each later slice's start.
        wanted: The slices to look at; ``None`` means all.
    """
    key = ["ticker", "epoch", "slice"]
    kind = log.schema["pos"].dataType
    rows = _toggles(log).select(*key, "side", "price_e4", "opened", "rank", "pos")
    start = carried.select(
        *key, "side", "price_e4", F.lit(True).alias("opened"), F.lit(-1).cast("bigint").alias("rank"), F.lit(None).cast(kind).alias("pos")
    )
    rows = rows.unionByName(start)
    if wanted is not None:
        rows = rows.join(wanted, key, "left_semi")
    # Levels carried in come first. All levels of an image act together, so they have one number.
    walk = Window.partitionBy(*key).orderBy(F.asc_nulls_first("pos"))
    rows = rows.repartition(*key).select(
        "*", F.dense_rank().over(walk).alias("n"), (~F.lag("pos").over(walk).eqNullSafe(F.col("pos"))).alias("leads")
    )
    rows = rows.withColumn("size", F.max("n").over(Window.partitionBy(*key)))
    closed = F.lead("n").over(Window.partitionBy(*key, "side", "price_e4").orderBy("rank"))
    rows = rows.withColumn("end", F.coalesce(closed, F.col("size") + 1))
    # Of levels that rest for the same stretch only the best counts: an image's many levels become a few rows.
    price = lambda side: F.when(F.col("opened") & (F.col("side") == side), F.col("price_e4"))
    rows = rows.groupBy(*key, "n", "end", "size", F.when(F.col("leads"), F.col("pos")).alias("pos"), "leads").agg(
        F.max(price(BID)).alias("bid"), F.min(price(ASK)).alias("ask")
    )
    none = F.lit(None)
    rests = F.transform(
        dyadic_blocks("n", "end", "size"),
        lambda b: F.struct(
            b["level"].alias("level"), b["block"].alias("block"), F.col("bid"), F.col("ask"),
            none.cast("int").alias("n"), none.cast(kind).alias("pos"),
        ),
    )
    meets = F.transform(
        dyadic_levels("size"),
        lambda h: F.struct(
            h.alias("level"), dyadic_block("n", h).alias("block"),
            none.cast("int").alias("bid"), none.cast("int").alias("ask"),
            F.col("n").alias("n"), F.when(h == 0, F.col("pos")).alias("pos"),
        ),
    )
    rest = F.when(F.coalesce("bid", "ask").isNotNull(), rests)
    empty = F.array().cast(f"array<struct<level:int,block:bigint,bid:int,ask:int,n:int,pos:{kind.simpleString()}>>")
    both = F.concat(F.coalesce(rest, empty), F.coalesce(F.when(F.col("leads"), meets), empty))
    parts = rows.select(*key, F.inline(both))
    block = Window.partitionBy(*key, "level", "block")
    parts = parts.select(*key, "n", "pos", F.max("bid").over(block).alias("bid"), F.min("ask").over(block).alias("ask"))
    return parts.where(F.col("n").isNotNull()).groupBy(*key, "n").agg(
        F.max("pos").alias("pos"), F.max("bid").alias("bid"), F.min("ask").alias("ask")
    )


def slice_facts(log: DataFrame) -> DataFrame:
    """One row per (market, epoch, slice): the best prices touched."""
    bid = F.when((F.col("side") == BID) & (F.col("count_e2") > 0), F.col("price_e4"))
    ask = F.when((F.col("side") == ASK) & (F.col("count_e2") > 0), F.col("price_e4"))
    return log.groupBy("ticker", "epoch", "slice").agg(F.max(bid).alias("t_bid"), F.min(ask).alias("t_ask"))


def plain_violations(log: DataFrame) -> DataFrame:
    """Rows that violate by themselves, as ``(ticker, epoch, slice, pos, kind)``."""
    base = (F.col("src") == 2) & F.col("base_stale")
    at_base = _instant(F.col("pos.stretch"), F.col("pos.mono"), 9).cast(log.schema["pos"].dataType)
    kinds = {"N": (F.col("src") == 0) & (F.col("count_e2") < 0), "X": ~F.col("valid"), "B": base}
    marks = [F.when(on, F.struct((at_base if k == "B" else F.col("pos")).alias("pos"), F.lit(k).alias("kind"))) for k, on in kinds.items()]
    found = log.where(kinds["N"] | kinds["X"] | kinds["B"])
    return found.select("ticker", "epoch", "slice", F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull())))


def crossings(log: DataFrame, facts: DataFrame, carried: DataFrame, plain_cuts: DataFrame) -> DataFrame:
    """First crossing of each epoch, as ``(ticker, epoch, pos)``.

    A slice's best prices are looked at only if its highest bid could reach its lowest ask, it did
    not already start crossed, and no slice before it did or held another violation.
    """
    key = ["ticker", "epoch", "slice"]
    side, price = F.col("side"), F.col("price_e4")
    at_start = carried.groupBy(*key).agg(
        F.max(F.when(side == BID, price)).alias("s_bid"),
        F.min(F.when(side == ASK, price)).alias("s_ask"),
    )
    joined = facts.join(at_start, key, "left")
    crossed = F.coalesce(F.col("s_bid") >= F.col("s_ask"), F.lit(False))
    # Slices of one epoch are few; the window runs over one summary row per slice.
    epoch = Window.partitionBy("ticker", "epoch")
    possible = F.greatest("s_bid", "t_bid") >= F.least("s_ask", "t_ask")
    wanted = (
        joined.withColumn("first_crossed", F.min(F.when(crossed, F.col("slice"))).over(epoch))
        .join(
            plain_cuts.select("ticker", "epoch", F.col("slice").alias("cut_slice")),
            ["ticker", "epoch"],
            "left",
        )
        .where(
            possible
            & ~crossed
            & (F.col("first_crossed").isNull() | (F.col("slice") < F.col("first_crossed")))
            & (F.col("cut_slice").isNull() | (F.col("slice") <= F.col("cut_slice")))
        )
        .select(*key)
    )
    quotes = _slice_quotes(log, carried, wanted)
    return (
        quotes.where((F.col("bid") >= F.col("ask")) & (F.col("pos.src") == 0))
        .groupBy("ticker", "epoch")
        .agg(F.min("pos").alias("pos"))
    )


def gap_cuts(log: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps that stale a book, at most one per run of its changes: ``(ticker, epoch, slice, pos)``.

    A run is a stretch of one market's changes from one subscription. The next gap of that
    subscription after the run's start counts if it comes before the run ends; at one reading a gap
    precedes a change.
    """
    at = F.struct(F.col("pos.stretch").alias("stretch"), F.col("pos.mono").alias("mono"))
    runs = log.where("run_start").select("ticker", "slice", "epoch", "conn_id", "sid", "pos", at.alias("at"))
    in_slice = Window.partitionBy("ticker", "slice").orderBy("pos")
    runs = runs.withColumn("next_in_slice", F.lead("at").over(in_slice))
    # Every slice starts a run, so a slice's last run ends where the market's next slice starts.
    firsts = runs.groupBy("ticker", "slice").agg(F.min("at").alias("first_at"))
    following = firsts.select(
        "ticker",
        "slice",
        F.lead("first_at").over(Window.partitionBy("ticker").orderBy("slice")).alias("next_slice"),
    )
    runs = (
        runs.join(following, ["ticker", "slice"])
        .withColumn("until", F.coalesce("next_in_slice", "next_slice"))
        .where(F.col("conn_id").isNotNull() & F.col("sid").isNotNull())
        .select("ticker", "epoch", "slice", "conn_id", "sid", "at", "until")
    )
    # Gaps of one reading are as one. A whole feed may lie within a minute, so no block of time would spread a subscription.
    found = asof_join(
        runs,
        gaps.select("conn_id", "sid", "stretch", "mono").distinct(),
        ["conn_id", "sid"],
        F.col("at"),
        F.struct("stretch", "mono"),
        None,
        None,
        ["stretch", "mono"],
        forward=True,
        allow_equal=False,
    )
    hits = found.where(
        F.col("found_at").isNotNull()
        & (F.col("until").isNull() | (F.col("found_at") <= F.col("until")))
    )
    return hits.select(
        "ticker", "epoch", "slice", _instant(F.col("stretch"), F.col("mono"), -1).alias("pos")
    )


def epoch_cuts(log: DataFrame, gaps: DataFrame) -> DataFrame:
    """The first violation of each epoch.

    Cuts are ``(ticker, epoch, cut, kind)`` with kinds ``G`` gap, ``X`` invalid image, ``N``
    negative level, ``C`` crossing, ``B`` base already stale. Epochs without a violation have no
    row.
    """
    key = ["ticker", "epoch"]
    facts = materialize(slice_facts(log), "slice-facts")
    plain = (
        plain_violations(log)
        .unionByName(gap_cuts(log, gaps).withColumn("kind", F.lit("G")))
        .groupBy(*key)
        .agg(F.min(F.struct("pos", "kind", "slice")).alias("m"))
        .select(*key, "m.*")
    )
    plain = materialize(plain, "plain-cuts")
    carried = open_at_slice_start(log)
    crossed = crossings(log, facts, carried, plain).withColumn("kind", F.lit("C"))
    both = (
        plain.select(*key, "pos", "kind")
        .unionByName(crossed)
        .groupBy(*key)
        .agg(F.min(F.struct("pos", "kind")).alias("m"))
        .select(*key, F.col("m.pos").alias("cut"), F.col("m.kind").alias("kind"))
    )
    return materialize(both, "cuts")


def applied_rows(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """The log's rows that took effect: those before their epoch's cut, and a crossing delta."""
    joined = log.join(cuts, ["ticker", "epoch"], "left")
    return joined.where(
        F.col("cut").isNull()
        | (F.col("pos") < F.col("cut"))
        | ((F.col("pos") == F.col("cut")) & (F.col("kind") == "C"))
    )


def latest_epoch(changes: DataFrame) -> DataFrame:
    """Each market's changes from its last valid image on; earlier ones cannot matter at the end."""
    starts = changes.where(F.col("valid") & (F.col("src") > 0))
    last = starts.groupBy("ticker").agg(F.max("pos").alias("image"))
    return changes.join(last, "ticker").where(F.col("pos") >= F.col("image")).drop("image")


def books_from(
    changes: DataFrame,
    gaps: DataFrame,
    tickers: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> Books:
    """Books after the last of some ordered changes.

    Args:
        changes: First output of :func:`ordered_changes`.
        gaps: Its second output.
        tickers: Markets that must appear in the status even without any change.
        slice_rows: Rows a slice aims to hold.
    """
    log = level_log(latest_epoch(changes), slice_rows)
    cuts = epoch_cuts(log, gaps)
    applied = applied_rows(log, cuts)
    levels = (
        applied.where(F.col("side") >= 0)
        .groupBy("ticker", "side", "price_e4")
        .agg(F.sum("delta_e2").alias("count_e2"))
        .where(F.col("count_e2") > 0)
        .withColumn("side", F.col("side").cast("tinyint"))
    )
    timed = F.when(
        F.col("ts_ms").isNotNull()
        & (F.col("cut").isNull() | (F.col("pos") < F.col("cut"))),
        F.col("pos"),
    )
    clock = applied.groupBy("ticker").agg(F.max_by("ts_ms", timed).alias("last_ts_ms"))
    everyone = changes.select("ticker").distinct()
    if tickers is not None:
        everyone = everyone.unionByName(tickers.select("ticker")).distinct()
    status = (
        everyone.join(clock.withColumn("known", F.lit(True)), "ticker", "left")
        .join(cuts.select("ticker", "kind"), "ticker", "left")
        .select(
            "ticker",
            (F.col("known").isNull() | F.col("kind").isNotNull()).alias("stale"),
            "last_ts_ms",
            F.when(F.col("known").isNull(), F.lit("unknown"))
            .otherwise(F.col("kind"))
            .alias("why"),
        )
    )
    return Books(levels=levels, status=status)


def replay(
    deltas: DataFrame,
    snapshots: DataFrame,
    gaps: DataFrame,
    keyframe: DataFrame | None = None,
    tickers: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> Books:
    """Apply stored changes to a keyframe's books in the order they were received."""
    changes, ordered_gaps = ordered_changes(deltas, snapshots, gaps, keyframe)
    return books_from(changes, ordered_gaps, tickers, slice_rows)


@dataclass(frozen=True)
class Timeline:
    """Every applied level change, the cuts, and the best prices over time."""

    log: DataFrame
    cuts: DataFrame
    slice_rows: int = SLICE_ROWS

    def changes(self) -> DataFrame:
        """Level counts after each applied change."""
        return applied_rows(self.log, self.cuts).where(F.col("side") >= 0)

    def top_of_book(self) -> DataFrame:
        """Best bid and ask after each applied change that opened or closed a level."""
        quotes = _slice_quotes(self.log, open_at_slice_start(self.log), None)
        kept = quotes.join(self.cuts, ["ticker", "epoch"], "left").where(
            F.col("cut").isNull() | (F.col("pos") < F.col("cut"))
        )
        return kept.select(
            "ticker", "epoch", "pos", "pos.stretch", "pos.mono", "pos.wall",
            F.col("bid").alias("best_bid"), F.col("ask").alias("best_ask"),
        )


def timeline(
    deltas: DataFrame,
    snapshots: DataFrame,
    gaps: DataFrame,
    keyframe: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> Timeline:
    """The whole history of every book in some stored changes, all epochs."""
    changes, ordered_gaps = ordered_changes(deltas, snapshots, gaps, keyframe)
    log = level_log(changes, slice_rows)
    return Timeline(log=log, cuts=epoch_cuts(log, ordered_gaps), slice_rows=slice_rows)


__all__ = [
    "Books", "Timeline", "applied_rows", "books_from", "crossings", "epoch_cuts", "gap_cuts",
    "keyframe_bases", "latest_epoch", "level_log", "open_at_slice_start", "ordered_changes", "replay",
    "snapshot_images", "timeline",
]
