"""Decoded bus envelopes as tables or streams, with arrival order and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookstrata.functions.markets import topic_of

EVENT_TYPES = ("refresh", "snapshot", "delta", "trade", "ticker", "lifecycle", "gap", "catalog", "status")


def well_formed(messages: DataFrame) -> DataFrame:
    """Envelopes with numbers and a known event type."""
    known = F.col("event_type").isin(*EVENT_TYPES)
    return messages.where((F.col("bus_epoch") >= 0) & (F.col("bus_seq") >= 1) & known)


def malformed_count(messages: DataFrame) -> DataFrame:
    good = (F.col("bus_epoch") >= 0) & (F.col("bus_seq") >= 1) & F.col("event_type").isin(*EVENT_TYPES)
    return messages.agg(F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("malformed"))


def with_topic(messages: DataFrame) -> DataFrame:
    return messages.withColumn("topic", topic_of("event_type", "ticker"))


def on_topics(messages: DataFrame, prefix: str) -> DataFrame:
    """Messages whose topic starts with a prefix; an empty prefix takes all."""
    return with_topic(messages).where(F.col("topic").startswith(prefix))
