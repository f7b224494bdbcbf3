"""Stored tables and keyframes: partitioned Parquet with explicit schemas.

Layout: ``<root>/<table>/dt=YYYY-MM-DD/hour=HH``. Rows are bucketed by CRC-32 of the partition key and
sorted, so row-group statistics let a reader of one market skip the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata import schemas
from bookstrata.functions.clock import (
    NS_PER_HOUR,
    WRITE_LAG_HOURS,
    hour_date,
    hour_of_day,
    keyframe_slot,
)
from bookstrata.session import materialize

BUCKETS = 64
MAX_PART_ROWS = 500_000
TASK_ROWS = 5_000_000
KEYFRAME_LOOKBACK_HOURS = 24
KEYFRAME_INTERVAL_S = 300


def bucket_of(key: Column | str, buckets: int = BUCKETS) -> Column:
    """CRC-32 bucket of a key's text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(buckets))


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_table(
    rows: DataFrame,
    root: str,
    name: str,
    tie: Sequence[str] = (),
    max_rows: int = MAX_PART_ROWS,
    task_rows: int = TASK_ROWS,
) -> None:
    """Write rows into their hour partitions, replacing each hour written as a whole.

    ``rows`` carries the stored columns and ``hour_label``. Rows of one (hour, bucket) are sorted in
    one task and split into files of at most ``max_rows``. Buckets are counted first, and one that
    holds more than ``task_rows`` in an hour, because of a hot key, is spread over enough tasks. Each
    file is still sorted; the files of such a bucket then cover the same keys.

    Args:
        rows: The rows.
        root: Archive root.
        name: Table name.
        tie: Extra columns that order rows equal in all sort keys.
        max_rows: Rows per file.
        task_rows: Rows of one bucket and hour a task should take.
    """
    spec = schemas.TABLES[name]
    extra = [c for c in tie if c in rows.columns and c not in spec.schema.fieldNames()]
    stored = rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields],
        *extra,
        F.substring("hour_label", 1, 10).alias("dt"),
        F.substring("hour_label", 12, 2).alias("hour"),
        bucket_of(spec.partition_key).alias("__bucket"),
    )
    place = ["dt", "hour", "__bucket"]
    heavy = stored.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows)
    # Usually nobody is heavy; at most total rows / task_rows groups are, one row each.
    spread = materialize(heavy.select(*place, F.ceil(F.col("n") / task_rows).alias("tasks")), "heavy")
    keys = [F.col(c) for c in place]
    if not spread.isEmpty():
        stored = stored.join(spread, place, "left")
        # A function of the row, not a random draw: a retried task must place rows the same way.
        row_hash = F.xxhash64(*[F.col(c) for c in spec.schema.fieldNames()])
        keys.append(F.pmod(row_hash, F.coalesce("tasks", F.lit(1).cast("bigint"))))
    order = [F.col(c).asc_nulls_last() for c in (*spec.sort_keys, *extra)]
    laid = stored.repartition(*keys).sortWithinPartitions("dt", "hour", *order)
    (
        laid.select(*spec.schema.fieldNames(), "dt", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows)
        .option("compression", "zstd")
        .option("parquet.enable.dictionary", "true")
        .partitionBy("dt", "hour")
        .parquet(table_path(root, name))
    )


def drop_partitions(spark: SparkSession, root: str, name: str, labels: Sequence[str]) -> None:
    """Remove hour partitions of a table; used when a re-bake leaves an hour without rows.

    Dynamic overwrite replaces only partitions that receive rows.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for label in labels:
        path = jvm.org.apache.hadoop.fs.Path(
            f"{table_path(root, name)}/dt={label[:10]}/hour={label[11:13]}"
        )
        path.getFileSystem(conf).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its ``dt`` and ``hour`` partition columns."""
    schema = schemas.with_partitions(schemas.TABLES[name].schema)
    return spark.read.schema(schema).parquet(table_path(root, name))


def hours_between(start_ns: int, end_ns: int) -> Column:
    """Partition filter for rows received in a range, one hour of write lag included."""
    first = start_ns - start_ns % NS_PER_HOUR
    last = end_ns - end_ns % NS_PER_HOUR + WRITE_LAG_HOURS * NS_PER_HOUR
    label = F.concat(F.col("dt"), F.lit("T"), F.col("hour"))
    low = F.concat(hour_date(F.lit(first)), F.lit("T"), hour_of_day(F.lit(first)))
    high = F.concat(hour_date(F.lit(last)), F.lit("T"), hour_of_day(F.lit(last)))
    # Bounds on dt alone come first so whole days are skipped without listing their hours.
    days = F.col("dt").between(hour_date(F.lit(first)), hour_date(F.lit(last)))
    return days & label.between(low, high)


def scan(
    table: DataFrame,
    start_ns: int,
    end_ns: int,
    *,
    left_open: bool = False,
    tickers: Sequence[str] | DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows received in ``[start, end)``, or ``(start, end]`` with ``left_open``.

    A short ticker list becomes a pushed-down filter; a DataFrame of tickers a semi-join.
    """
    if end_ns < start_ns:
        raise ValueError(f"range ends at {end_ns} before it starts at {start_ns}")
    at = F.col("recv_wall_ns")
    inside = (at > start_ns) & (at <= end_ns) if left_open else (at >= start_ns) & (at < end_ns)
    rows = table.where(hours_between(start_ns, end_ns)) if "dt" in table.columns else table
    rows = rows.where(inside)
    if isinstance(tickers, DataFrame):
        rows = rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    elif tickers is not None:
        wanted = sorted(set(tickers))
        rows = rows.where(F.col("ticker") == wanted[0] if len(wanted) == 1 else F.col("ticker").isin(wanted))
    return rows if columns is None else rows.select(*columns)


def write_keyframe(rows: DataFrame, root: str, interval_s: int = KEYFRAME_INTERVAL_S) -> None:
    """Write keyframe rows under the slot their instant falls in."""
    slot = keyframe_slot("as_of_recv_ns", interval_s)
    minute = F.lpad((F.pmod(slot, F.lit(NS_PER_HOUR)) / 60_000_000_000).cast("int").cast("string"), 2, "0")
    placed = rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.KEYFRAMES.fields],
        hour_date("as_of_recv_ns").alias("dt"), hour_of_day("as_of_recv_ns").alias("hour"),
        minute.alias("slot"),
    )
    laid = placed.repartition("dt", "hour", "slot", bucket_of("ticker")).sortWithinPartitions(
        "dt", "hour", "slot", "ticker", "side", "price_e4"
    )
    (
        laid.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_PART_ROWS)
        .partitionBy("dt", "hour", "slot")
        .parquet(table_path(root, "keyframes"))
    )


def read_keyframes(spark: SparkSession, root: str, tickers: Sequence[str] | None = None) -> DataFrame:
    schema = schemas.with_partitions(schemas.KEYFRAMES).add("slot", "string")
    rows = spark.read.schema(schema).parquet(table_path(root, "keyframes"))
    return rows if tickers is None else rows.where(F.col("ticker").isin(sorted(set(tickers))))


def latest_keyframe(keyframes: DataFrame, at_ns: int, lookback_hours: int = KEYFRAME_LOOKBACK_HOURS) -> tuple[DataFrame, int]:
    """Rows of the latest keyframe taken at or before an instant, and when it was taken.

    With none in the lookback, an empty keyframe and the lookback's start.
    """
    if lookback_hours < 0:
        raise ValueError("lookback_hours must be non-negative")
    floor_ns = at_ns - at_ns % NS_PER_HOUR - lookback_hours * NS_PER_HOUR
    rows = keyframes
    if "dt" in rows.columns:
        rows = rows.where(hours_between(floor_ns, at_ns))
    as_of = F.col("as_of_recv_ns")
    taken = rows.where((as_of <= at_ns) & (as_of >= floor_ns)).agg(F.max(as_of).alias("t")).first().t
    if taken is None:
        return rows.where(F.lit(False)), floor_ns
    # The instant is known, so only its own partition is read.
    return rows.where(hours_between(taken, taken) & (as_of == taken)) if "dt" in rows.columns else rows.where(as_of == taken), taken
