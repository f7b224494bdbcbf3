"""Raw segments to stored tables, accounting and integrity facts, for any number of hours at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.functions.clock import is_closed_hour, parse_hour_label
from bookstrata.operators import integrity as I
from bookstrata.operators import records as R
from bookstrata.operators.retention import hours_to_bake
from bookstrata.session import materialize
from bookstrata.sources import manifests as M
from bookstrata.sources import segments as S
from bookstrata.sources import tables as T

BAKE_VERSION = 1
SOFTWARE = "bookstrata"
# How long after its end an hour may still receive files.
GRACE_NS = 600_000_000_000


@dataclass(frozen=True)
class Baked:
    """Everything interpreting some segments found."""

    tables: dict[str, DataFrame]
    facts: DataFrame
    accounting: DataFrame
    failures: DataFrame
    spans: DataFrame
    sleeps: DataFrame
    gap_facts: DataFrame
    overflow: DataFrame


def interpret(raw: DataFrame) -> Baked:
    """Interpret the output of the segment reader."""
    facts = materialize(S.segment_facts(raw), "facts")
    # Read by nine results below, so it is written once.
    classified = materialize(R.classify(S.records(raw)), "classified")
    rows = {
        "deltas": R.delta_rows(classified),
        "snapshots": R.snapshot_rows(classified),
        "trades": R.trade_rows(classified),
        "lifecycle": R.lifecycle_rows(classified),
        "gaps": I.gap_rows(classified, facts),
        "audits": R.audit_rows(classified),
    }
    return Baked(
        tables=rows,
        facts=facts,
        accounting=R.accounting(classified),
        failures=R.failure_samples(classified),
        spans=I.connection_spans(classified, facts),
        sleeps=I.host_sleeps(classified),
        gap_facts=I.gap_facts(classified, facts),
        overflow=I.overflow_dropped(classified),
    )


def bake(spark: SparkSession, raw_root: str | list[str], archive_root: str) -> Baked:
    """Read every segment under a folder, replace its hours' tables, and write their days' manifests.

    Baking the same segments again writes the same rows, so a repeated run is safe; an interrupted one
    leaves hours that the manifest does not know, which the next :func:`incremental_bake` bakes.
    """
    raw = materialize(S.read_segments(spark, raw_root), "raw")
    baked = interpret(raw)
    hours = [r.hour_label for r in baked.facts.select("hour_label").distinct().collect()]
    for name, rows in baked.tables.items():
        kept = [r.h for r in rows.select(F.col("hour_label").alias("h")).distinct().collect()]
        T.write_table(rows, archive_root, name, tie=("segment", "ordinal"))
        T.drop_partitions(spark, archive_root, name, sorted(set(hours) - set(kept)))
    if hours:
        write_day_manifests(spark, archive_root, baked, sorted(hours))
    return baked


def _key(label: str = "hour_label") -> list[Column]:
    return [F.substring(label, 1, 10).alias("dt"), F.substring(label, 12, 2).cast("int").alias("hour")]


def _counts(account: DataFrame, outcome: str | None, by: str, name: str) -> DataFrame:
    rows = account if outcome is None else account.where(F.col("outcome") == outcome)
    summed = rows.groupBy("hour_label", by).agg(F.sum("records").alias("n"))
    return summed.groupBy("hour_label").agg(F.map_from_entries(F.collect_list(F.struct(by, "n"))).alias(name))


def hour_entries(baked: Baked) -> DataFrame:
    """What a manifest says of each hour: accounting and integrity facts."""
    empty = F.create_map().cast("map<string,bigint>")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in S.KINDS.items() for x in pair]), F.col("kind").cast("int"))
    account = baked.accounting.withColumn("kind", kind)
    corrupt = baked.facts.groupBy("hour_label").agg(F.count_if(F.col("corrupt").isNotNull()).alias("corrupt_segments"))
    hours = corrupt
    for outcome, by, name in ((None, "kind", "records"), ("baked", "key", "baked"), ("not_baked", "key", "not_baked"), ("failure", "key", "decode_failures")):
        hours = hours.join(_counts(account, outcome, by, name), "hour_label", "left")
    span = F.struct("conn_id", "start_wall_ns", "end_wall_ns", "opened", "closed")
    spans = baked.spans.groupBy("hour_label").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    sleep = F.struct("start_wall_ns", "end_wall_ns")
    sleeps = baked.sleeps.groupBy("hour_label").agg(F.sort_array(F.collect_list(sleep)).alias("sleeps"))
    audits = I.audit_summary(baked.tables["audits"], ["hour_label"])
    for part in (spans, sleeps, baked.gap_facts, audits, baked.overflow):
        hours = hours.join(part, "hour_label", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return hours.select(
        *_key(),
        F.lit(BAKE_VERSION).alias("bake_version"),
        F.lit(SOFTWARE).alias("software_version"),
        F.struct(
            *[F.coalesce(c, empty).alias(c) for c in ("records", "baked", "not_baked", "decode_failures")],
            number("corrupt_segments").alias("corrupt_segments"),
        ).alias("accounting"),
        F.struct(
            F.coalesce("spans", F.array()).alias("spans"),
            F.coalesce("sleeps", F.array()).alias("sleeps"),
            F.struct(
                number("gaps").alias("count"), number("stale_market_ns").alias("stale_market_ns"),
                number("observed_market_ns").alias("observed_market_ns"),
            ).alias("gaps"),
            F.struct(
                *[number(f"books_{o}").alias(o) for o in ("exact", "consistent", "inconsistent", "undecidable")],
                number("levels_mismatched").alias("levels_mismatched"),
            ).alias("audits"),
            number("dropped").alias("writer_overflow_dropped"),
        ).alias("integrity"),
    )


def part_entries(spark: SparkSession, archive_root: str, hours: list[str]) -> DataFrame:
    """Every stored file of some hours: dt, hour, table, path, rows, bytes and hash."""
    out = None
    inside = F.concat("dt", F.lit("T"), F.col("hour")).isin(hours)
    relative = F.regexp_extract("path", r"([^/]+/dt=[^/]+/hour=[^/]+/[^/]+)$", 1)
    for name in M.TABLE_NAMES:
        folders = [f"{T.table_path(archive_root, name)}/dt={h[:10]}/hour={h[11:13]}" for h in hours]
        folders = [f for f in folders if T.exists(spark, f)]
        if not folders:
            continue
        rows = T.read_table(spark, archive_root, name).where(inside)
        counted = rows.groupBy("dt", "hour", F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        counted = counted.select("dt", F.col("hour").cast("int").alias("hour"), relative.alias("path"), "rows")
        digests = S.file_digests(spark, folders, "*.parquet").select(relative.alias("path"), "bytes", "sha256")
        part = counted.join(digests, "path").withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def write_day_manifests(spark: SparkSession, archive_root: str, baked: Baked, hours: list[str]) -> None:
    """Put the hours just baked into their days' manifests; what these say of other hours stays."""
    where = f"{archive_root.rstrip('/')}/manifests"
    days = sorted({h[:10] for h in hours})
    fresh_hours = hour_entries(baked)
    fresh_segments = baked.facts.select(
        *_key(), F.col("segment").alias("path"), "bytes", "sha256", "records", "first_recv_wall_ns", "last_recv_wall_ns", "truncated"
    )
    fresh_parts = part_entries(spark, archive_root, hours)
    stored = M.read_manifests(spark, where).where(F.col("date").isin(days)) if T.exists(spark, where) else spark.createDataFrame([], M.MANIFEST)
    done = fresh_hours.select("dt", "hour")

    def merged(old: DataFrame, new: DataFrame | None) -> DataFrame:
        rest = old.join(done, ["dt", "hour"], "left_anti")
        return rest if new is None else rest.unionByName(new.select(*rest.columns))

    def listed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        return rows.groupBy("dt").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    # A day's manifest is one document: its lists have a few entries for each of 24 hours.
    by_hour = merged(M.manifest_hours(stored), fresh_hours).groupBy("dt").agg(
        F.collect_list(F.struct("hour", "bake_version", "software_version", "accounting", "integrity")).alias("hours")
    )
    segments = listed(merged(M.manifest_segments(stored), fresh_segments), ["path", "hour", "bytes", "sha256", "records", "first_recv_wall_ns", "last_recv_wall_ns", "truncated"], "segments")
    parts = merged(M.manifest_parts(stored), fresh_parts)
    pruned = stored.select(F.col("date").alias("dt"), "pruned")
    out = by_hour.join(segments, "dt", "left").join(pruned, "dt", "left")
    for name in M.TABLE_NAMES:
        own = parts.where(F.col("table") == name)
        files = listed(own, ["path", "hour", "rows", "bytes", "sha256"], f"files_{name}")
        out = out.join(files, "dt", "left")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, f: a + f["rows"])
    files_of = lambda n: F.coalesce(F.col(f"files_{n}"), F.array())
    order = F.array_sort("hours", lambda a, b: a["hour"] - b["hour"])
    document = out.select(
        F.lit(1).alias("version"),
        F.col("dt").alias("date"),
        F.lit(SOFTWARE).alias("software_version"),
        F.coalesce("segments", F.array()).alias("segments"),
        F.struct(*[F.struct(total(files_of(n)).alias("rows"), files_of(n).alias("files")).alias(n) for n in M.TABLE_NAMES]).alias("tables"),
        F.struct(order.alias("hours")).alias("bake"),
        F.coalesce("pruned", F.array()).alias("pruned"),
    )
    # Written aside first, because the days it reads are the days it replaces.
    M.write_manifests(materialize(document, "manifests"), where)


def closed_hours_to_bake(spark: SparkSession, raw_root: str, archive_root: str, now_ns: int, grace_ns: int) -> DataFrame:
    """dt, hour, why and folder of each hour that ended over ``grace_ns`` ago and whose raw names or sizes,
    version or stored files are not what its manifest says."""
    files = S.inventory(spark, raw_root).where(is_closed_hour(parse_hour_label("hour_label"), now_ns, grace_ns))
    disk = files.select(*_key(), F.col("segment").alias("path"), "bytes", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"))
    where = f"{archive_root.rstrip('/')}/manifests"
    stored = M.read_manifests(spark, where) if T.exists(spark, where) else spark.createDataFrame([], M.MANIFEST)
    stored = materialize(stored, "manifests")
    parts_here = None
    for name in M.TABLE_NAMES:
        folder = T.table_path(archive_root, name)
        if T.exists(spark, folder):
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
            found = found.select(F.regexp_extract("path", r"([^/]+/dt=[^/]+/hour=[^/]+/[^/]+)$", 1).alias("path"))
            parts_here = found if parts_here is None else parts_here.unionByName(found)
    if parts_here is None:
        parts_here = spark.createDataFrame([], "path string")
    pruned = M.manifest_pruned(stored).select("dt", F.split("path", "/")[1].cast("int").alias("hour"))
    why = hours_to_bake(
        disk.drop("folder"), parts_here, M.manifest_hours(stored), M.manifest_segments(stored), M.manifest_parts(stored), pruned, BAKE_VERSION
    )
    return why.join(disk.select("dt", "hour", "folder").distinct(), ["dt", "hour"])


def incremental_bake(spark: SparkSession, raw_root: str, archive_root: str, now_ns: int, grace_ns: int = GRACE_NS) -> list[str]:
    """Bake the closed hours that need it; returns their labels.

    Inventories decide, by name and size, so a file that grew or came late has its hour baked again, and
    an hour still being written waits. Running again changes nothing.
    """
    # One row an hour folder.
    found = closed_hours_to_bake(spark, raw_root, archive_root, now_ns, grace_ns).select("dt", "hour", "folder").collect()
    if found:
        bake(spark, sorted({r.folder for r in found}), archive_root)
    return sorted({f"{r.dt}T{r.hour:02d}" for r in found})
