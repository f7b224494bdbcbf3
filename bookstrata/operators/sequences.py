"""Sequence-number verdicts, counters and bus continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookstrata.operators.running import Running, running

FIRST_BUS_SEQ = 1


def sequence_verdicts(
    messages: DataFrame,
    keys: Sequence[str],
    block: Sequence[str],
    order: Sequence[str],
    seq: str = "seq",
    reset: str | None = None,
) -> DataFrame:
    """Classify each message by its sequence number: ``first``, ``ok``, ``gap`` or ``duplicate``.

    The baseline is the highest number seen since the last reset, because a number that does not
    advance leaves it where it was. Unsequenced messages are ``ok``. ``reset`` names a flag that
    forgets the baseline just before the row's own number is judged.

    Args:
        messages: One row per message.
        keys: Columns naming one subscription, connection and its opening included.
        block: Columns splitting a subscription into ordered blocks.
        order: Receive order within a block.
        seq: The sequence number column.
        reset: Optional boolean column.
    """
    rows = messages
    group = list(keys)
    if reset is not None:
        flag = F.when(F.coalesce(F.col(reset), F.lit(False)), 1).otherwise(0)
        rows = running(rows, keys, block, order, {"reset_no": Running("sum", flag)})
        group.append("reset_no")
    rows = running(rows, group, block, order, {"baseline": Running("max", F.col(seq), current=False)})
    expected = F.col("baseline") + 1
    number = F.col(seq)
    verdict = (
        F.when(number.isNull(), "ok")
        .when(F.col("baseline").isNull(), "first")
        .when(number == expected, "ok")
        .when(number > expected, "gap")
        .otherwise("duplicate")
    )
    odd = F.col("verdict").isin("gap", "duplicate")
    return (
        rows.withColumn("verdict", verdict)
        .withColumn("expected_seq", F.when(odd, expected))
        .withColumn("got_seq", F.when(odd, number))
        .drop("baseline")
    )


def gap_counters(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Messages, gaps and duplicates per subscription."""
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count(F.when(F.col("verdict") == "gap", 1)).alias("gaps"),
        F.count(F.when(F.col("verdict") == "duplicate", 1)).alias("duplicates"),
    )


def bus_continuity(
    messages: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Whether each bus message follows the one before it, in arrival order.

    Adds ``reset`` (``start``, ``epoch``, ``gap`` or NULL), ``missed`` and ``generation``, which
    counts resets: everything held from an older generation is unknown.
    """
    previous = F.struct(F.col("bus_epoch").alias("epoch"), F.col("bus_seq").alias("seq"))
    rows = running(
        messages, keys, block, order, {"previous": Running("last", previous, current=False)}
    )
    seq = F.col("bus_seq")
    reset = (
        F.when(F.col("previous").isNull(), "start")
        .when(F.col("bus_epoch") != F.col("previous.epoch"), "epoch")
        .when(seq != F.col("previous.seq") + 1, "gap")
    )
    missed = (
        F.when(F.col("reset") == "epoch", seq - FIRST_BUS_SEQ)
        .when(F.col("reset") == "gap", F.greatest(F.lit(0), seq - F.col("previous.seq") - 1))
        .otherwise(F.lit(0))
    )
    rows = rows.withColumn("reset", reset).withColumn("missed", missed).drop("previous")
    happened = F.when(F.col("reset").isNotNull(), 1).otherwise(0)
    return running(rows, keys, block, order, {"generation": Running("sum", happened)})


def bus_stats(observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters over bus messages with their outcome (see the live-books operators)."""
    outcome = F.col("outcome")
    return observed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("reset").alias("resets"),
        F.sum("missed").alias("missed"),
        F.count(F.when(outcome == "refreshed", 1)).alias("refreshes"),
        F.count(F.when(outcome == "ignored", 1)).alias("ignored"),
        F.count(F.when(outcome == "error", 1)).alias("book_errors"),
    )
