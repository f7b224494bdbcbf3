"""Running aggregates and as-of joins that never put one key's rows into one task.

A plain ``Window.partitionBy(key)`` sends every row of a hot key to a single task. Here each key's
rows are split into ordered blocks (a time bucket, a run of record ordinals). Within a block an
ordinary window runs; across blocks only one summary row per block is carried forward. The rows of
a hot key therefore spread over as many tasks as it has blocks.

Keys and blocks must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.session import materialize


@dataclass(frozen=True)
class Running:
    """One running aggregate.

    ``kind`` is ``sum``, ``max``, ``min`` or ``last`` (latest non-NULL value in order). With
    ``current=False`` the row itself is left out.
    """

    kind: str
    value: Column
    current: bool = True


def _over(kind: str, value: Column, frame: Window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return getattr(F, kind)(value).over(frame)


def _whole_block(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return getattr(F, kind)(value)


def _combine(kind: str, carried: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(inside, F.lit(0))
    if kind == "max":
        return F.greatest(carried, inside)
    if kind == "min":
        return F.least(carried, inside)
    return F.coalesce(inside, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Sequence[str],
    order: Sequence[str],
    specs: dict[str, Running],
) -> DataFrame:
    """Add running aggregates per key in ``(block, order)`` order.

    Args:
        df: The rows.
        keys: Columns naming one ordered sequence.
        block: Columns that split a sequence into consecutive ordered blocks.
        order: Columns ordering rows within a block.
        specs: The aggregates, by output column.
    """
    parts = [*keys, *block]
    order_key = F.struct(*[F.col(c) for c in order])
    staged = df
    for name, spec in specs.items():
        staged = staged.withColumn(f"__v_{name}", spec.value)
    totals = staged.groupBy(*parts).agg(
        *[
            _whole_block(spec.kind, F.col(f"__v_{name}"), order_key).alias(f"__t_{name}")
            for name, spec in specs.items()
        ]
    )
    before = (
        Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *parts,
        *[_over(s.kind, F.col(f"__t_{n}"), before).alias(f"__c_{n}") for n, s in specs.items()],
    )
    inside = Window.partitionBy(*parts).orderBy(*order)
    for name, spec in specs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.current else -1)
        staged = staged.withColumn(f"__i_{name}", _over(spec.kind, F.col(f"__v_{name}"), frame))
    joined = staged.join(carried, parts, "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in specs],
        *[
            _combine(s.kind, F.col(f"__c_{n}"), F.col(f"__i_{n}")).alias(n)
            for n, s in specs.items()
        ],
    )


def latest_rows(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], n: int
) -> DataFrame:
    """The last ``n`` rows of each key, exactly.

    Row counts per block tell which blocks can hold them, so only those blocks' rows are ranked
    and a hot key never sends more than ``n`` rows and one block to a task.
    """
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n"))
    later = Window.partitionBy(*keys).orderBy(F.col(block).desc())
    after = F.sum("__n").over(later.rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.where(F.col("__n") > 0).withColumn("__after", F.coalesce(after, F.lit(0)))
    needed = needed.where(F.col("__after") < n).select(*keys, block)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    held = df.join(needed, [*keys, block], "left_semi").withColumn("__rank", rank)
    return held.where(F.col("__rank") <= n).drop("__rank")


def _in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``__block``, the range of ``order`` they lie in; left rows of one place may lie in several."""
    laid = rows.repartitionByRange(*order, F.xxhash64("__row"))
    return materialize(laid.withColumn("__block", F.spark_partition_id()), "asof")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: Column,
    right_order: Column,
    left_block: Column | None,
    right_block: Column | None,
    payload: Sequence[str],
    *,
    forward: bool = False,
    allow_equal: bool = True,
    prefix: str = "",
) -> DataFrame:
    """For each left row, the nearest right row of the same keys before (or after) it.

    Left rows without a match keep NULL payload. Ties between right rows at one order value go to
    the last one in ``payload`` order. Both block columns must bucket the same order axis.

    Args:
        left: Rows to look up for.
        right: Rows to find.
        keys: Equality columns present on both sides.
        left_order: Position of a left row.
        right_order: Position of a right row, of the same type.
        left_block: Block of a left row; consistent with the order. Without blocks the rows of both sides are laid out in
            ranges of the order, so that rows of one instant spread, too; the ranges are written to the shared folder.
        right_block: Block of a right row.
        payload: Right columns to return.
        forward: Look for the next right row instead of the previous one.
        allow_equal: Whether a right row at the left row's own position matches.
        prefix: Put before payload names in the output.
    """
    block = lambda given: (F.lit(0) if given is None else given).alias("__block")
    held = F.struct(right_order.alias("__at"), *[F.col(c).alias(c) for c in payload])
    rights = right.select(
        *keys, block(right_block), right_order.alias("__at"), held.alias("__found")
    ).withColumn("__right", F.lit(1))
    lefts = left.select(
        *keys,
        block(left_block),
        left_order.alias("__at"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__row"),
    ).withColumn("__right", F.lit(0))
    rows = rights.unionByName(lefts, allowMissingColumns=True)
    # At one position, put matching right rows on the near side of the left row.
    right_first = allow_equal != forward
    rank = F.col("__right") if not right_first else -F.col("__right")
    rows = rows.withColumn("__rank", rank)
    if left_block is None:
        rows = _in_ranges(rows, [*keys, "__at", "__rank", "__found"])
    parts = [*keys, "__block"]
    # Looking forward is looking back in the opposite order. A frame that ends at the last row is evaluated anew for every row,
    # which takes the square of a block's rows; one that starts at the first row only grows.
    toward = F.desc if forward else F.asc
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*map(toward, order)).rowsBetween(Window.unboundedPreceding, -1)
    order_key = F.when(F.col("__found").isNotNull(), F.struct("__at", "__found"))
    nearest = F.min_by if forward else F.max_by
    inside = F.last("__found", ignorenulls=True).over(before(parts, ["__at", "__rank", "__found"]))
    totals = rows.groupBy(*parts).agg(nearest("__found", order_key).alias("__edge"))
    carry = F.last("__edge", ignorenulls=True).over(before(keys, ["__block"]))
    carried = totals.select(*parts, carry.alias("__carry"))
    matched = (
        rows.withColumn("__inside", inside)
        .where(F.col("__right") == 0)
        .join(carried, parts, "left")
        .withColumn("__hit", F.coalesce("__inside", "__carry"))
    )
    return matched.select(
        "__row.*",
        F.col("__hit.__at").alias(f"{prefix}at") if prefix else F.col("__hit.__at").alias("found_at"),
        *[F.col(f"__hit.{c}").alias(f"{prefix}{c}") for c in payload],
    )


def dyadic_levels(size: Column | str) -> Column:
    """Exponents of the block sizes that numbers up to ``size`` and the one after need."""
    size = F.col(size) if isinstance(size, str) else size
    return F.sequence(F.lit(0), F.ceil(F.log2(size + 2)).cast("int"))


def dyadic_blocks(first: str, end: str, size: str) -> Column:
    """The fewest aligned blocks of powers of two that make up ``[first, end)``, as (level, block).

    A block is used if it lies inside and the one of twice its size around it does not: on each level
    at most the first one, if its number is odd, and the last one, if its number is even. So what holds
    for a stretch is kept by block, and a number meets all stretches around it in one block a level.
    """

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2), level)
        low = F.ceil(F.col(first) / width).cast("bigint")
        high = F.floor(F.col(end) / width).cast("bigint")
        used = (F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
        return F.array(*[F.struct(level.alias("level"), block.alias("block")) for block in used])

    return F.filter(F.flatten(F.transform(dyadic_levels(size), at)), lambda b: b["block"].isNotNull())


def dyadic_block(number: Column | str, level: Column) -> Column:
    """The block of a level that a number lies in."""
    number = F.col(number) if isinstance(number, str) else number
    return F.floor(number / F.pow(F.lit(2), level)).cast("bigint")
