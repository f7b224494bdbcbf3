"""Depth heatmap: per market, time bin and price row, the depth resting at the bin's end.

Only what changed is stored per bin. Dense columns are produced for the bins asked for, which a
viewer bounds to its history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_MINUTE, NS_PER_MS
from bookstrata.functions.exact import floor_div
from bookstrata.functions.grid import BIN_MS, depth_value, row_for_price
from bookstrata.operators.replay import Timeline, applied_rows
from bookstrata.operators.running import Running, latest_rows, running

# Column status codes, from best to worst.
FRESH, STALE, UNKNOWN, GAP = 0, 1, 2, 3
BLOCK_BINS = 4_096
SHOWN_TRADES = 12


@dataclass(frozen=True)
class Heatmap:
    """Depth cells and per-column quotes and status, for the bins asked for."""

    cells: DataFrame
    columns: DataFrame


def wall_bin(wall_ns: Column | str, origin_ns: int, bin_ms: int = BIN_MS) -> Column:
    """Whole bin of a wall instant, never below zero."""
    column = F.col(wall_ns) if isinstance(wall_ns, str) else wall_ns
    return F.greatest(F.lit(0), floor_div(column - F.lit(origin_ns), bin_ms * NS_PER_MS)).cast("bigint")


def _epochs(line: Timeline, origin_ns: int, bin_ms: int) -> DataFrame:
    """Each epoch's bins: it is shown from the bin it starts in until a later epoch's first bin.

    Only the last epoch to start in a bin is shown at all, so the bins are looked along with one row
    per bin, however many images a market has.
    """
    starts = line.log.groupBy("ticker", "epoch").agg(F.min("wall").alias("wall"))
    starts = starts.select("ticker", "epoch", wall_bin("wall", origin_ns, bin_ms).alias("start_bin"))
    order = Window.partitionBy("ticker").orderBy("start_bin")
    shown = starts.groupBy("ticker", "start_bin").agg(F.max("epoch").alias("shown"))
    shown = shown.withColumn("following", F.lead("start_bin").over(order))
    last = F.col("epoch") == F.col("shown")
    return starts.join(shown, ["ticker", "start_bin"]).select(
        "ticker", "epoch", "start_bin",
        F.when(last, F.col("following")).otherwise(F.col("start_bin")).alias("next_bin"),
    )


def _spread(df: DataFrame, first: Column, last: Column, lo: int, hi: int) -> DataFrame:
    """Repeat rows over the asked bins of ``[first, last]``; open when ``last`` is NULL."""
    low = F.greatest(first, F.lit(lo))
    high = F.least(F.coalesce(last, F.lit(hi)), F.lit(hi))
    return df.withColumn("lo", low).withColumn("hi", high).where(F.col("lo") <= F.col("hi")).withColumn(
        "bin", F.explode(F.sequence("lo", "hi"))
    ).drop("lo", "hi")


def row_changes(line: Timeline, origin_ns: int, row_step: int, rows: int, bin_ms: int = BIN_MS) -> DataFrame:
    """Contracts per price row after each bin in which the row changed, per epoch, floored at 0."""
    applied = applied_rows(line.log, line.cuts).where(F.col("side") >= 0)
    row = row_for_price("price_e4", F.lit(row_step), F.lit(rows))
    summed = (
        applied.groupBy("ticker", "epoch", row.alias("row"), wall_bin("wall", origin_ns, bin_ms).alias("bin"))
        .agg(F.sum("delta_e2").alias("change"))
        .withColumn("block", floor_div("bin", BLOCK_BINS))
    )
    total = running(
        summed, ["ticker", "epoch", "row"], ["block"], ["bin"], {"total": Running("sum", F.col("change"))}
    )
    return total.select("ticker", "epoch", "row", "bin", F.greatest(F.lit(0), F.col("total")).alias("total_e2"))


def heatmap(
    line: Timeline,
    origin_ns: int,
    first_bin: int,
    last_bin: int,
    row_step: int = 100,
    rows: int = 101,
    bin_ms: int = BIN_MS,
) -> Heatmap:
    """Dense columns for ``[first_bin, last_bin]``.

    Bins without a message inherit the book before them; a bin shows the last values in it and the
    worst status it saw.
    """
    epochs = _epochs(line, origin_ns, bin_ms)
    changes = row_changes(line, origin_ns, row_step, rows, bin_ms)
    nxt = Window.partitionBy("ticker", "epoch", "row").orderBy("bin")
    held = changes.withColumn("next_change", F.lead("bin").over(nxt)).join(epochs, ["ticker", "epoch"])
    last = F.least("next_change", "next_bin") - 1
    cells = _spread(held.withColumnRenamed("bin", "from_bin"), F.col("from_bin"), last, first_bin, last_bin)
    cells = cells.where(F.col("total_e2") > 0).select(
        "ticker", "bin", "row", "total_e2", depth_value(F.col("total_e2") / 100).alias("depth")
    )
    quotes = line.top_of_book().withColumn("bin", wall_bin("wall", origin_ns, bin_ms))
    quotes = quotes.groupBy("ticker", "epoch", "bin").agg(
        F.max_by(F.struct("best_bid", "best_ask"), "pos").alias("q")
    )
    steps = Window.partitionBy("ticker", "epoch").orderBy("bin")
    shown = quotes.withColumn("next_change", F.lead("bin").over(steps)).join(epochs, ["ticker", "epoch"])
    quoted = _spread(
        shown.withColumnRenamed("bin", "from_bin"), F.col("from_bin"), last, first_bin, last_bin
    ).select("ticker", "bin", "q.best_bid", "q.best_ask")
    columns = status_bins(line, origin_ns, first_bin, last_bin, bin_ms).join(quoted, ["ticker", "bin"], "left")
    return Heatmap(cells=cells, columns=columns.select("ticker", "bin", "best_bid", "best_ask", "status"))


def status_bins(line: Timeline, origin_ns: int, first_bin: int, last_bin: int, bin_ms: int = BIN_MS) -> DataFrame:
    """Worst status of each asked bin: unknown before the first image, fresh, stale after a cut."""
    epochs = _epochs(line, origin_ns, bin_ms)
    cut_bin = wall_bin(F.col("cut.wall"), origin_ns, bin_ms)
    # A gap's cut carries no wall time of its own; its bin comes from the monotonic offset.
    cuts = line.cuts.select("ticker", "epoch", "cut", "kind")
    starts = line.log.groupBy("ticker", "epoch").agg(
        F.min(F.struct("pos", "wall")).alias("s")
    ).select("ticker", "epoch", (F.col("s.wall") - F.col("s.pos.mono")).alias("offset"))
    timed = cuts.join(starts, ["ticker", "epoch"]).select(
        "ticker", "epoch",
        F.when(F.col("cut.wall") > 0, cut_bin)
        .otherwise(wall_bin(F.col("cut.mono") + F.col("offset"), origin_ns, bin_ms)).alias("cut_bin"),
    )
    spans = epochs.join(timed, ["ticker", "epoch"], "left")
    kinds = F.array(
        F.struct(F.lit(FRESH).alias("status"), F.col("start_bin").alias("a"), F.coalesce("cut_bin", "next_bin").alias("b")),
        F.struct(F.lit(STALE).alias("status"), F.col("cut_bin").alias("a"), F.col("next_bin").alias("b")),
        F.struct(
            F.lit(UNKNOWN).alias("status"), F.when(F.col("epoch") == 1, F.lit(0).cast("bigint")).alias("a"),
            F.when(F.col("epoch") == 1, F.col("start_bin")).alias("b"),
        ),
    )
    pieces = spans.select("ticker", F.inline(kinds)).where(F.col("a").isNotNull())
    # A market never imaged is unknown throughout and has no column here.
    spread = _spread(pieces, F.col("a"), F.col("b"), first_bin, last_bin)
    return spread.groupBy("ticker", "bin").agg(F.max("status").alias("status"))


def sample_bins(columns: DataFrame, asked: DataFrame, head: DataFrame) -> DataFrame:
    """Column each asked ``(ticker, bin)`` is drawn with.

    Before the oldest stored bin there is none and the status is unknown; after the head the head's
    column continues with the edge status.

    Args:
        columns: Stored columns ``(ticker, bin, best_bid, best_ask, status)``.
        asked: Bins to draw.
        head: ``(ticker, oldest_bin, head_bin, edge_status)``.
    """
    placed = asked.join(head, "ticker", "left")
    after = F.col("bin") > F.col("head_bin")
    before = F.col("head_bin").isNull() | (F.col("bin") < F.col("oldest_bin"))
    use = F.when(before, None).when(after, F.col("head_bin")).otherwise(F.col("bin"))
    found = placed.withColumn("column", use).join(
        columns.withColumnRenamed("bin", "column"), ["ticker", "column"], "left"
    )
    status = F.when(before, UNKNOWN).when(after, F.col("edge_status")).otherwise(
        F.coalesce("status", F.lit(UNKNOWN))
    )
    return found.select("ticker", "bin", "column", "best_bid", "best_ask", status.cast("int").alias("status"))


def trade_points(trades: DataFrame, origin_ns: int, bin_ms: int = BIN_MS, keep: int | None = None) -> DataFrame:
    """Where each market's trades are drawn: fractional bin, price, contracts and side.

    All trades, or the latest ``keep`` of each market if the caller asks for a number.
    """
    at = F.greatest(F.lit(0.0), (F.col("recv_wall_ns") - origin_ns) / (bin_ms * NS_PER_MS))
    rows = trades
    if keep is not None:
        timed = trades.withColumn("block", floor_div("recv_wall_ns", NS_PER_MINUTE))
        rows = latest_rows(timed, ["ticker"], "block", ["recv_wall_ns", "trade_id"], keep)
    return (
        rows.select("ticker", "trade_id", at.alias("bin"), "price_e4", (F.col("count_e2") / 100).alias("contracts"), "taker_side")
    )


def recent_trades(trades: DataFrame, n: int = SHOWN_TRADES) -> DataFrame:
    """Each market's latest ``n`` trades, newest first.

    The rank filter also runs before the shuffle, so a busy market ships only a few rows per task.
    """
    if n < 1:
        raise ValueError(f"n must be positive, not {n}")
    latest = Window.partitionBy("ticker").orderBy(F.col("recv_wall_ns").desc(), F.col("trade_id").desc())
    return trades.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= n)


def session_maxima(trades: DataFrame, rows: DataFrame) -> DataFrame:
    """Largest trade and deepest price row per market, in contracts."""
    big = trades.groupBy("ticker").agg((F.max("count_e2") / 100).alias("max_trade_contracts"), F.count(F.lit(1)).alias("trades"))
    deep = rows.groupBy("ticker").agg((F.max("total_e2") / 100).alias("max_row_contracts"))
    return big.join(deep, "ticker", "full")
