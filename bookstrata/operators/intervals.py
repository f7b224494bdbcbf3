"""Unions, overlaps and joins of time intervals, by sums of start and end markers.

An interval union is the region where more starts than ends have been seen. Counting markers with a
blocked running sum keeps one host's or connection's whole history from landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_HOUR
from bookstrata.functions.exact import floor_div
from bookstrata.operators.running import Running, running


def union_intervals(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str = "start_wall_ns",
    end: str = "end_wall_ns",
    block_ns: int = NS_PER_HOUR,
) -> DataFrame:
    """Merge touching or overlapping intervals per key into disjoint ones.

    Args:
        intervals: Rows with a start and an end not before it.
        keys: Columns naming separate timelines.
        start: Start column.
        end: End column.
        block_ns: Width of the time blocks the running counts are split into.
    """
    marks = F.array(
        F.struct(F.col(start).alias("at"), F.lit(0).alias("closing"), F.lit(1).alias("step")),
        F.struct(F.col(end).alias("at"), F.lit(1).alias("closing"), F.lit(-1).alias("step")),
    )
    points = intervals.select(*keys, F.inline(marks))
    # Equal markers are combined first, so one instant adds at most two rows per key.
    points = points.groupBy(*keys, "at", "closing").agg(F.sum("step").alias("step"))
    points = points.withColumn("block", floor_div("at", block_ns)).withColumn("one", F.lit(0))
    counted = running(
        points, [*keys, "one"], ["block"], ["at", "closing"],
        {"depth": Running("sum", F.col("step"))},
    )
    # Starts sort before ends at one instant, so touching intervals never drop to zero between.
    opens = (F.col("depth") - F.col("step") == 0) & (F.col("closing") == 0)
    closes = (F.col("depth") == 0) & (F.col("closing") == 1)
    edges = counted.where(opens | closes)
    ordered = Window.partitionBy(*keys, "one").orderBy("at", "closing")
    # Only the merged intervals' edges remain here.
    return (
        edges.withColumn("until", F.lead("at").over(ordered))
        .where(F.col("closing") == 0)
        .select(*keys, F.col("at").alias(start), F.col("until").alias(end))
    )


def clip_to_days(intervals: DataFrame, start: str = "start_wall_ns", end: str = "end_wall_ns") -> DataFrame:
    """Cut intervals at midnights: one row per interval and day, with ``day`` numbered from 1970."""
    day_ns = 24 * NS_PER_HOUR
    last = F.greatest(floor_div(start, day_ns), floor_div(F.col(end) - 1, day_ns))
    cut = intervals.withColumn("day", F.explode(F.sequence(floor_div(start, day_ns), last)))
    low = F.greatest(F.col(start), F.col("day") * day_ns)
    high = F.least(F.col(end), (F.col("day") + 1) * day_ns)
    return cut.withColumn(start, low).withColumn(end, high).where(F.col(end) > F.col(start))


def overlap_ns(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    start: str = "start_wall_ns",
    end: str = "end_wall_ns",
    block_ns: int = NS_PER_HOUR,
) -> DataFrame:
    """Total time covered by both of two sets of disjoint intervals, per key, as ``overlap_ns``.

    Both sides are cut into blocks and joined on (key, block), so no key is joined whole.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        first = floor_div(start, block_ns)
        last = F.greatest(first, floor_div(F.col(end) - 1, block_ns))
        rows = df.select(*keys, start, end, F.explode(F.sequence(first, last)).alias("block"))
        return rows.select(
            *keys,
            "block",
            F.greatest(F.col(start), F.col("block") * block_ns).alias(f"{name}_lo"),
            F.least(F.col(end), (F.col("block") + 1) * block_ns).alias(f"{name}_hi"),
        )

    both = cut(a, "a").join(cut(b, "b"), [*keys, "block"])
    shared = F.greatest(F.lit(0), F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"))
    return both.groupBy(*keys).agg(F.sum(shared).alias("overlap_ns"))


def covered_ns(intervals: DataFrame, keys: Sequence[str], start: str = "start_wall_ns", end: str = "end_wall_ns") -> DataFrame:
    """Total length of disjoint intervals per key, as ``covered_ns``."""
    return intervals.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered_ns"))


def seconds(total_ns: Column) -> Column:
    return floor_div(total_ns, 1_000_000_000)
