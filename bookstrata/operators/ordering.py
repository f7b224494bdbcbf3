"""Receive order: monotonic time within one host boot, host boots in wall-clock order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_MINUTE, RESTART_DROP_NS
from bookstrata.functions.exact import floor_div
from bookstrata.session import materialize

BOUNDARY = "wall bigint, src int, mono bigint"


def _readings(events: DataFrame, wall: str, mono: str, src: str) -> DataFrame:
    return events.select(
        F.col(wall).cast("bigint").alias("wall"),
        F.col(src).cast("int").alias("src"),
        F.col(mono).cast("bigint").alias("mono"),
    )


def _doubtful_minutes(rows: DataFrame) -> DataFrame:
    """Lowest and highest reading of each minute, and whether it could hold a restart."""
    start = (floor_div("wall", NS_PER_MINUTE) * NS_PER_MINUTE).alias("wall")
    pieces = rows.groupBy(start).agg(F.min("mono").alias("lo"), F.max("mono").alias("hi"))
    # One row for each minute of recorded time.
    sequence = Window.orderBy("wall")
    wide = (F.col("hi") - F.col("lo")) > RESTART_DROP_NS
    return pieces.withColumn(
        "doubtful",
        wide
        | F.coalesce(F.lag(wide).over(sequence), F.lit(False))
        | F.coalesce(F.col("lo") < F.lag("lo").over(sequence), F.lit(False)),
    )


def restarts(events: DataFrame, wall: str = "wall", mono: str = "mono", src: str = "src") -> DataFrame:
    """Rows at which the monotonic clock restarted, as ``(wall, src, mono)``.

    A restart is a reading more than ten minutes below the highest since the last restart, in wall
    order. Only minutes that could hold one are read: those whose readings spread over more than ten
    minutes, those after such a one, and those whose lowest reading lies below that of the minute
    before. In any other minute a restart is impossible: the highest reading so far was taken in an
    earlier minute of the same stretch, so every minute since, the previous one included, stayed
    within ten minutes of it, and a restart would have to go below the previous minute's lowest
    reading. Such a minute counts as one reading, its highest, that can only raise the maximum.

    The readings left are sorted once and walked in blocks of ``BLOCK_ROWS``, all at the same time. What a
    block does depends on the highest reading before it, so each block is first summed up by what it
    makes of *any* highest reading (:class:`Effect`); effects are combined within each partition of the
    sort and then across partitions, one row each, and every block learns its own highest reading on the
    way back. So clocks that interleave all day, with every minute in doubt, are walked in parallel.
    """
    rows = _readings(events, wall, mono, src)
    marked = materialize(_doubtful_minutes(rows), "minutes")
    doubtful = marked.where("doubtful").select(F.col("wall").alias("piece"))
    rows = rows.withColumn("piece", floor_div("wall", NS_PER_MINUTE) * NS_PER_MINUTE).join(doubtful, "piece", "left_semi").drop("piece")
    calm = marked.where(~F.col("doubtful")).select("wall", F.lit(0).alias("src"), F.col("hi").alias("mono"), F.lit(False).alias("raw"))
    return restart_rows(rows.withColumn("raw", F.lit(True)).unionByName(calm))


BLOCK_ROWS = 1 << 12
_ROW_BITS = 33  # of the number that Spark gives a row, those that count rows of one partition
_EFFECT = "part bigint, block bigint, ends array<bigint>, results array<bigint>"


class Effect:
    """What a run of readings makes of the highest reading before it.

    ``results[i]`` is the highest reading after the run if the one before was above ``ends[i - 1]`` (or none)
    and at most ``ends[i]`` (without an end for the last); None leaves it as it was. The highest reading before
    decides only which reading first takes its place, so outcomes merge and an effect stays short.
    """

    def __init__(self, ends: Sequence[int] = (), results: Sequence[int | None] = (None,)) -> None:
        self.ends, self.results = deque(ends), deque(results)

    def of(self, highest: int | None) -> int | None:
        at = 0 if highest is None else bisect_left(self.ends, highest)
        return highest if self.results[at] is None else self.results[at]

    def after(self, reading: int, raw: bool) -> None:
        """Put one reading before the run. Only readings from it up to ten minutes above it pass it unchanged."""
        taken = self.of(reading)
        while self.ends and self.ends[0] <= reading:
            self.ends.popleft()
            self.results.popleft()
        if self.results[0] != taken:
            self.ends.appendleft(reading)
            self.results.appendleft(taken)
        if raw:
            above = reading + RESTART_DROP_NS
            while self.ends and self.ends[-1] >= above:
                self.ends.pop()
                self.results.pop()
            if self.results[-1] != taken:
                self.ends.append(above)
                self.results.append(taken)

    def then(self, later: Effect) -> Effect:
        """This run and, after it, ``later``."""
        ends: list[int] = []
        results: list[int | None] = []
        low = None
        for i, result in enumerate(self.results):
            high = self.ends[i] if i < len(self.ends) else None
            if result is not None:
                pieces = [(high, later.of(result))]
            else:
                inner = [e for e in later.ends if (low is None or e > low) and (high is None or e < high)]
                first = 0 if low is None else bisect_right(later.ends, low)
                pieces = list(zip([*inner, high], list(later.results)[first : first + len(inner) + 1], strict=True))
            for end, value in pieces:
                if results and results[-1] == value:
                    ends.pop()
                else:
                    results.append(value)
                ends.append(end)
            low = high
        return Effect(ends[:-1], results)


def restart_rows(readings: DataFrame) -> DataFrame:
    """``(wall, src, mono)`` of the restarts among ``(wall, src, mono, raw)``; others than raw rows only raise the maximum."""
    order = ["wall", "src", "mono", "raw"]
    laid = readings.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    laid = laid.select(
        *order, number.alias("row"), F.shiftright(number, _ROW_BITS).alias("part"), F.shiftright(number, BLOCK_ROWS.bit_length() - 1).alias("block")
    )
    laid = materialize(laid, "readings")

    def sum_up(rows: pd.DataFrame) -> pd.DataFrame:
        effect = Effect()
        rows = rows.sort_values("row", ascending=False)
        for reading, raw in zip(rows["mono"].tolist(), rows["raw"].tolist(), strict=True):
            effect.after(reading, raw)
        return _as_row(rows, effect)

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        total = Effect()
        for effect in _effects(rows.sort_values("block")):
            total = total.then(effect)
        return _as_row(rows, total)

    def pass_on(rows: pd.DataFrame, highest: int | None) -> pd.DataFrame:
        rows = rows.sort_values(["part", "block"])
        before = []
        for effect in _effects(rows):
            before.append(_NONE if highest is None else highest)
            highest = effect.of(highest)
        return rows[["part", "block"]].assign(highest=before)

    def from_start(rows: pd.DataFrame) -> pd.DataFrame:
        return pass_on(rows, None)[["part", "highest"]]

    def from_part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pass_on(left, _known(right))

    def walk(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        highest, found = _known(state), []
        rows = rows.sort_values("row")
        for wall, src, reading, raw in rows[["wall", "src", "mono", "raw"]].itertuples(index=False):
            if raw and highest is not None and reading < highest - RESTART_DROP_NS:
                found.append((wall, src, reading))
                highest = reading
            else:
                highest = reading if highest is None else max(highest, reading)
        return pd.DataFrame(found, columns=["wall", "src", "mono"])

    blocks = materialize(laid.groupBy("part", "block").applyInPandas(sum_up, _EFFECT), "effects")
    parts = blocks.groupBy("part").applyInPandas(combine, _EFFECT)
    # One row for each partition of the sort.
    starts = parts.groupBy(F.lit(0).alias("all")).applyInPandas(from_start, "part bigint, highest bigint")
    starts = blocks.groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(from_part, "part bigint, block bigint, highest bigint")
    key = ["part", "block"]
    return laid.groupBy(*key).cogroup(starts.groupBy(*key)).applyInPandas(walk, BOUNDARY)


# Instead of NULL, which would turn the 64-bit columns into doubles in pandas.
_NONE = -(1 << 63)


def _as_row(rows: pd.DataFrame, effect: Effect) -> pd.DataFrame:
    results = [_NONE if r is None else r for r in effect.results]
    row = (rows["part"].iloc[0], rows["block"].iloc[0], list(effect.ends), results)
    return pd.DataFrame([row], columns=["part", "block", "ends", "results"])


def _effects(rows: pd.DataFrame) -> Iterator[Effect]:
    for ends, results in zip(rows["ends"], rows["results"], strict=True):
        yield Effect(ends.tolist(), [None if r == _NONE else r for r in results.tolist()])


def _known(state: pd.DataFrame) -> int | None:
    highest = int(state["highest"].iloc[0])
    return None if highest == _NONE else highest


def restart_boundaries(
    events: DataFrame, wall: str = "wall", mono: str = "mono", src: str = "src"
) -> list[tuple[int, int, int]]:
    """The restart rows as literals: one per host boot, so a handful per year of data.

    The result is metadata that several plans embed; finding it once spares each of them another
    pass over the receipts.
    """
    rows = _readings(events, wall, mono, src)
    if _doubtful_minutes(rows).where("doubtful").isEmpty():
        return []
    found = restarts(events, wall, mono, src).collect()
    return sorted((r.wall, r.src, r.mono) for r in found)


def with_stretch(
    events: DataFrame,
    boundaries: list[tuple[int, int, int]],
    wall: str = "wall",
    mono: str = "mono",
    src: str = "src",
) -> DataFrame:
    """Number the host boot each row belongs to, from 0, as ``stretch``.

    Args:
        events: Rows with wall and monotonic receive times and a source rank.
        boundaries: Output of :func:`restart_boundaries` over all of the rows together.
        wall: Name of the wall time column.
        mono: Name of the monotonic time column.
        src: Name of the source rank column, which orders rows at one wall time.
    """
    if not boundaries:
        return events.withColumn("stretch", F.lit(0))
    here = F.struct(
        F.col(wall).cast("bigint").alias("wall"),
        F.col(src).cast("int").alias("src"),
        F.col(mono).cast("bigint").alias("mono"),
    )
    one = "struct<wall:bigint,src:int,mono:bigint>"
    listed = F.array(
        *[F.struct(F.lit(w), F.lit(s), F.lit(m)).cast(one) for w, s, m in boundaries]
    )
    count = F.size(F.filter(listed, lambda b: b <= here))
    return events.withColumn("stretch", count.cast("int"))


def minute_block(mono: Column | str) -> Column:
    """The time block that splits one key's rows for blocked windows."""
    return floor_div(mono, NS_PER_MINUTE)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 among all rows by ``order``; written to the shared folder.

    As :func:`ranked` without keys, but each range's first number is one row, which meets its rows without a shuffle.
    """
    place = F.monotonically_increasing_id()
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("__row", place).withColumn("__part", F.shiftright(place, _ROW_BITS)), name)
    # One row per range, a few hundred at most.
    pieces = laid.groupBy("__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = materialize(pieces.select("__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")), f"{name}-ranges")
    placed = laid.join(F.broadcast(pieces), "__part")
    return placed.withColumn("rank", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def ranked(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 among all rows of their keys by ``order``; written to the shared folder.

    The rows are sorted once into ranges of (keys, order), whose ends Spark samples, so rows of one key spread over as
    many tasks as they fill. Spark numbers the rows of each range; a range's first number and count for each key, one
    row, turn these into ranks. Equal rows may come in any order.
    """
    place = F.monotonically_increasing_id()
    laid = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    laid = materialize(laid.withColumn("__row", place).withColumn("__part", F.shiftright(place, _ROW_BITS)), name)
    pieces = laid.groupBy(*keys, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    placed = laid.join(pieces, [*keys, "__part"])
    return placed.withColumn("rank", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")
