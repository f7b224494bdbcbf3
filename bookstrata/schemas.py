"""Explicit schemas of every stored table and input shape.

Prices are 1/10,000 dollar in INT, counts 1/100 contract in BIGINT, times are integers in the unit
their name ends with. Nothing is inferred and no stored column is floating point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    """Build a schema from ``name type`` pairs; a type ending in ``?`` is nullable."""
    kinds = {
        "string": T.StringType(),
        "long": T.LongType(),
        "int": T.IntegerType(),
        "short": T.ShortType(),
        "byte": T.ByteType(),
        "bool": T.BooleanType(),
        "binary": T.BinaryType(),
    }
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


LEVEL = T.StructType(
    [T.StructField("price_e4", T.IntegerType()), T.StructField("count_e2", T.LongType())]
)
SIDED_LEVEL = T.StructType(
    [
        T.StructField("side", T.ByteType()),
        T.StructField("price_e4", T.IntegerType()),
        T.StructField("count_e2", T.LongType()),
    ]
)
RATIO = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
PRICE_RANGE = T.StructType(
    [
        T.StructField("start_e4", T.IntegerType()),
        T.StructField("end_e4", T.IntegerType()),
        T.StructField("step_e4", T.IntegerType()),
    ]
)

DELTAS = _fields(
    "ticker string,ts_ms long?,recv_mono_ns long,recv_wall_ns long,conn_id short,sid int,"
    "seq long?,side byte,price_e4 int,delta_e2 long,own_client_order_id string?"
)
SNAPSHOTS = _fields(
    "ticker string,recv_wall_ns long,recv_mono_ns long,conn_id short,sid int,seq long?,"
    "side byte,price_e4 int,count_e2 long,reason byte"
)
TRADES = _fields(
    "ticker string,trade_id string,ts_ms long,recv_wall_ns long,sid int,seq long?,"
    "price_e4 int,count_e2 long,taker_side byte,is_block bool"
)
LIFECYCLE = _fields(
    "ticker string,msg_type string,event_type string?,ts_s long?,recv_wall_ns long,sid int,"
    "seq long?,payload_json string"
)
GAPS = _fields(
    "conn_id short,sid int,recv_wall_ns long,recv_mono_ns long,expected_seq long,got_seq long,"
    "resolved_recv_wall_ns long?"
)
AUDITS = _fields(
    "ticker string,recv_wall_ns long,conn_id short,outcome string,send_wall_ns long,"
    "send_mono_ns long,recv_mono_ns long,window_open_mono_ns long,window_close_mono_ns long,"
    "window_events int,match_index int?,levels_rest int,levels_local int?,"
    "mismatched_levels int?,max_abs_diff_e2 long?,fault string?,rest_levels_json string?,"
    "local_levels_json string?"
)
KEYFRAMES = _fields(
    "ticker string,side byte,price_e4 int,count_e2 long,as_of_recv_ns long,last_ts_ms long?,"
    "stale bool"
)
RAW_RECORDS = _fields(
    "segment string,ordinal long,kind byte,conn_id int,recv_mono_ns long,recv_wall_ns long,"
    "payload binary,use_yes_price bool"
)
LISTING = _fields(
    "ticker string,series_ticker string,event_ticker string,exchange_index int,status string,"
    "volume_24h long,close_ts long?,is_mve bool,strike_type string?,yes_bid int?,yes_ask int?,"
    "last_price int?"
)


@dataclass(frozen=True)
class TableSpec:
    """How one stored table is laid out."""

    schema: T.StructType
    sort_keys: tuple[str, ...]
    partition_key: str


# The column each table is bucketed by and the order rows are stored in.
TABLES: dict[str, TableSpec] = {
    "deltas": TableSpec(DELTAS, ("ticker", "ts_ms", "seq", "recv_wall_ns"), "ticker"),
    "snapshots": TableSpec(
        SNAPSHOTS, ("ticker", "recv_wall_ns", "seq", "side", "price_e4"), "ticker"
    ),
    "trades": TableSpec(TRADES, ("ticker", "ts_ms", "seq", "trade_id"), "ticker"),
    "lifecycle": TableSpec(LIFECYCLE, ("ticker", "recv_wall_ns", "seq"), "ticker"),
    "gaps": TableSpec(GAPS, ("conn_id", "recv_wall_ns", "sid"), "conn_id"),
    "audits": TableSpec(AUDITS, ("ticker", "recv_wall_ns"), "ticker"),
    "keyframes": TableSpec(KEYFRAMES, ("ticker", "side", "price_e4"), "ticker"),
}


def with_partitions(schema: T.StructType) -> T.StructType:
    """A stored schema with its hive partition columns."""
    return T.StructType(
        [
            *schema.fields,
            T.StructField("dt", T.StringType()),
            T.StructField("hour", T.StringType()),
        ]
    )
