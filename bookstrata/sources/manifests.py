"""Archive manifests: what was read, written and measured, per hour and per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.functions.clock import segment_hour

_SEGMENT = (
    "path STRING, hour INT, bytes BIGINT, sha256 STRING, records BIGINT, "
    "first_recv_wall_ns BIGINT, last_recv_wall_ns BIGINT, truncated BOOLEAN"
)
_PART = "path STRING, hour INT, rows BIGINT, bytes BIGINT, sha256 STRING"
_TABLE = f"STRUCT<rows BIGINT, files ARRAY<STRUCT<{_PART}>>>"
_COUNTS = "MAP<STRING, BIGINT>"
_HOUR = (
    "hour INT, bake_version INT, software_version STRING, accounting STRUCT<"
    f"records {_COUNTS}, baked {_COUNTS}, not_baked {_COUNTS}, decode_failures {_COUNTS}, "
    "corrupt_segments BIGINT>, integrity STRUCT<spans ARRAY<STRUCT<conn_id INT, "
    "start_wall_ns BIGINT, end_wall_ns BIGINT, opened BOOLEAN, closed BOOLEAN>>, sleeps "
    "ARRAY<STRUCT<start_wall_ns BIGINT, end_wall_ns BIGINT>>, gaps STRUCT<count BIGINT, "
    "stale_market_ns BIGINT, observed_market_ns BIGINT>, audits STRUCT<exact BIGINT, consistent "
    "BIGINT, inconsistent BIGINT, undecidable BIGINT, levels_mismatched BIGINT>, "
    "writer_overflow_dropped BIGINT>"
)
# Fixed layout of a day's manifest document.
MANIFEST = (
    f"version INT, date STRING, software_version STRING, segments ARRAY<STRUCT<{_SEGMENT}>>, "
    f"tables STRUCT<deltas {_TABLE}, snapshots {_TABLE}, trades {_TABLE}, lifecycle {_TABLE}, "
    f"gaps {_TABLE}, audits {_TABLE}>, bake STRUCT<hours ARRAY<STRUCT<{_HOUR}>>>, "
    "pruned ARRAY<STRUCT<path STRING, bytes BIGINT, sha256 STRING, pruned_wall_ns BIGINT>>"
)
TABLE_NAMES = ("deltas", "snapshots", "trades", "lifecycle", "gaps", "audits")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per day's manifest; malformed documents fail the read."""
    reader = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST")
    return reader.json(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Write days' manifests as JSON documents, replacing the days present."""
    laid = manifests.withColumn("dt", F.col("date")).repartition("dt")
    (
        laid.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("dt")
        .json(path)
    )


def manifest_hours(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.col("date").alias("dt"), F.inline("bake.hours"))


def manifest_segments(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.col("date").alias("dt"), F.inline("segments"))


def manifest_pruned(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.col("date").alias("dt"), F.inline("pruned"))


def manifest_parts(manifests: DataFrame) -> DataFrame:
    named = F.array(
        *[F.struct(F.lit(t).alias("table"), F.col(f"tables.{t}.files").alias("files")) for t in TABLE_NAMES]
    )
    rows = manifests.select(F.col("date").alias("dt"), F.inline(named))
    return rows.select("dt", "table", F.inline("files"))


def replace_hours(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("dt", "hour")) -> DataFrame:
    """Everything known about other hours, plus the fresh facts of the hours baked again."""
    done = fresh.select(*keys).distinct()
    return stored.join(done, list(keys), "left_anti").unionByName(fresh)


def add_pruned(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Record pruned segments; one recorded already keeps its first record."""
    rest = [c for c in stored.columns if c != "path"]
    both = stored.unionByName(fresh)
    return both.groupBy("path").agg(F.min_by(F.struct(*rest), "pruned_wall_ns").alias("r")).select("path", "r.*")


def table_totals(parts: DataFrame) -> DataFrame:
    """Rows, files and bytes per table and hour."""
    return parts.groupBy("dt", "hour", "table").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def violations(manifests: DataFrame) -> DataFrame:
    """Ways manifests contradict themselves, one row each; empty when consistent."""
    day = F.col("date").alias("dt")
    hours = manifest_hours(manifests)
    segments, parts = manifest_segments(manifests), manifest_parts(manifests)
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, v: a + v)
    acc = F.col("accounting")
    accounted = total(acc["baked"]) + total(acc["not_baked"]) + total(acc["decode_failures"])
    found = [
        hours.where(total(acc["records"]) != accounted).select("dt", F.lit("records not accounted for").alias("problem"), F.col("hour").cast("string").alias("what")),
        hours.groupBy("dt", "hour").count().where(F.col("count") > 1).select("dt", F.lit("hour baked twice").alias("problem"), F.col("hour").cast("string").alias("what")),
        segments.groupBy("dt", "path").count().where(F.col("count") > 1).select("dt", F.lit("segment listed twice").alias("problem"), F.col("path").alias("what")),
        segments.where(
            ~segment_hour("path").eqNullSafe(F.concat("dt", F.lit("T"), F.lpad(F.col("hour").cast("string"), 2, "0")))
        ).select("dt", F.lit("segment not in its hour").alias("problem"), F.col("path").alias("what")),
        segments.join(hours.select("dt", "hour"), ["dt", "hour"], "left_anti").select("dt", F.lit("segment of an hour not baked").alias("problem"), F.col("path").alias("what")),
        parts.join(hours.select("dt", "hour"), ["dt", "hour"], "left_anti").select("dt", F.lit("part of an hour not baked").alias("problem"), F.col("path").alias("what")),
        parts.where(
            ~F.col("path").startswith(F.concat("table", F.lit("/dt="), "dt", F.lit("/hour="), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit("/")))
        ).select("dt", F.lit("part not under its hour").alias("problem"), F.col("path").alias("what")),
        manifests.select(
            day,
            F.inline(F.array(*[F.struct(F.lit(t).alias("table"), F.col(f"tables.{t}.rows").alias("rows"),
                F.aggregate(F.col(f"tables.{t}.files"), F.lit(0).cast("bigint"), lambda a, f: a + f["rows"]).alias("sum")) for t in TABLE_NAMES])),
        ).where(F.col("rows") != F.col("sum")).select("dt", F.lit("table rows differ from its files").alias("problem"), F.col("table").alias("what")),
        manifest_pruned(manifests).join(segments.select("dt", "path", "bytes", "sha256"), ["dt", "path", "bytes", "sha256"], "left_anti")
        .select("dt", F.lit("pruned segment was never baked").alias("problem"), F.col("path").alias("what")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
