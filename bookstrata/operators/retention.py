"""Which hours need baking and which may be pruned, from inventories of files and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookstrata.functions.clock import NS_PER_HOUR, label_hours

# Every reason an hour is kept, in the order a decision lists them.
PRUNE_REASONS = (
    "inside_retention_window", "not_baked", "bake_version_stale", "segment_added",
    "segment_changed", "segment_missing", "decode_failures", "baked_file_missing",
    "baked_file_changed", "unverified",
)
KEY = ["dt", "hour"]


def compare_inventories(on_disk: DataFrame, listed: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Each path's state: ``added``, ``changed``, ``missing``, ``unverified`` or ``same``.

    Inventories are ``(dt, hour, path, bytes, sha256)``; a NULL hash on disk is a check not made.
    """
    disk = on_disk.select(*KEY, "path", F.col("bytes").alias("d_bytes"), F.col("sha256").alias("d_sha"), F.lit(True).alias("here"))
    known = listed.select(*KEY, "path", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"), F.lit(True).alias("known"))
    both = disk.join(known, [*KEY, "path"], "full")
    gone = F.lit(False)
    if pruned is not None:
        both = both.join(pruned.select("path", F.lit(True).alias("was_pruned")).distinct(), "path", "left")
        gone = F.col("was_pruned").isNotNull()
    state = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("here").isNull() & gone, "pruned")
        .when(F.col("here").isNull(), "missing")
        .when(F.col("d_bytes") != F.col("m_bytes"), "changed")
        .when(F.col("d_sha").isNull(), "unverified")
        .when(F.col("d_sha") != F.col("m_sha"), "changed")
        .otherwise("same")
    )
    return both.select(*KEY, "path", state.alias("state"), F.col("d_bytes").alias("bytes"))


def prune_decisions(
    hours_on_disk: DataFrame,
    segments_on_disk: DataFrame,
    parts_on_disk: DataFrame,
    baked_hours: DataFrame,
    segments: DataFrame,
    parts: DataFrame,
    pruned: DataFrame,
    now_ns: int,
    retention_hours: int,
    bake_version: int,
) -> DataFrame:
    """Whether each hour's raw segments may be deleted, with every reason against it.

    ``unverified`` is given only when it is the sole reason. Hash only the hours whose sole reason
    it is and decide them again.

    Args:
        hours_on_disk: ``dt, hour`` of hours with raw segments.
        segments_on_disk: Inventory of raw files.
        parts_on_disk: Inventory of stored parts that exist.
        baked_hours: ``dt, hour, bake_version, failures``.
        segments: Inventory the manifests list.
        parts: Stored parts the manifests list.
        pruned: Paths already pruned.
        now_ns: The current wall time.
        retention_hours: How long raw segments are kept after their hour ends.
        bake_version: The current output version.
    """
    raw = compare_inventories(segments_on_disk, segments, pruned)
    files = compare_inventories(parts_on_disk.withColumn("bytes", F.lit(0)), parts.withColumn("bytes", F.lit(0)))
    names = {"added": "segment_added", "changed": "segment_changed", "missing": "segment_missing", "unverified": "unverified"}
    file_names = {"changed": "baked_file_changed", "missing": "baked_file_missing", "unverified": "unverified"}

    def flags(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
        reason = F.lit(None).cast("string")
        for state, name in mapping.items():
            reason = F.when(F.col("state") == state, name).otherwise(reason)
        return df.select(*KEY, reason.alias("reason")).where(F.col("reason").isNotNull()).distinct()

    baked = baked_hours.select(*KEY, "bake_version", "failures")
    base = hours_on_disk.join(baked, KEY, "left")
    # Counted in hours, because nanoseconds of hours past the year 2262 are no BIGINT. What names no hour stays.
    end = label_hours(F.concat("dt", F.lit("T"), "hour")) + 1
    inside = F.coalesce(end + retention_hours >= -(-now_ns // NS_PER_HOUR), F.lit(True))
    simple = base.select(
        *KEY,
        F.explode(F.filter(F.array(
            F.when(inside, "inside_retention_window"),
            F.when(F.col("bake_version").isNull(), "not_baked"),
            F.when(F.col("bake_version") != bake_version, "bake_version_stale"),
            F.when(F.col("failures") > 0, "decode_failures"),
        ), lambda r: r.isNotNull())).alias("reason"),
    )
    # An hour never baked has only that against it besides the window.
    compared = flags(raw, names).unionByName(flags(files, file_names)).join(baked.select(*KEY), KEY, "left_semi")
    reasons = simple.unionByName(compared)
    ranks = F.array(*[F.lit(r) for r in PRUNE_REASONS])
    collected = reasons.groupBy(*KEY).agg(F.collect_set("reason").alias("given"))
    others = F.filter("given", lambda r: r != "unverified")
    kept = F.when(F.size(others) > 0, others).otherwise(F.col("given"))
    ordered = F.filter(ranks, lambda r: F.array_contains(kept, r))
    sizes = raw.where(F.col("bytes").isNotNull()).groupBy(*KEY).agg(F.sum("bytes").alias("bytes"))
    out = hours_on_disk.select(*KEY).join(collected, KEY, "left").join(sizes, KEY, "left")
    listed = F.coalesce(F.when(F.col("given").isNotNull(), ordered), F.array().cast("array<string>"))
    return out.select(*KEY, listed.alias("reasons"), "bytes").select(
        *KEY, (F.size("reasons") == 0).alias("prunable"), "reasons",
        F.when(F.size("reasons") == 0, F.coalesce("bytes", F.lit(0))).otherwise(F.lit(0)).alias("bytes_freed"),
    )


def hours_to_bake(
    segments_on_disk: DataFrame,
    parts_on_disk: DataFrame,
    baked_hours: DataFrame,
    segments: DataFrame,
    parts: DataFrame,
    pruned_hours: DataFrame,
    bake_version: int,
) -> DataFrame:
    """Hours whose raw names or sizes, version or parts differ from what their manifest says.

    Hours with a pruned segment never need it; content hashes are left to the prune decision.
    """
    disk = segments_on_disk.withColumn("sha256", F.lit(None).cast("string"))
    raw = compare_inventories(disk, segments)
    differs = F.bool_or(F.col("state").isin("added", "changed", "missing"))
    compared = raw.groupBy(*KEY).agg(differs.alias("differs"), F.bool_or(F.col("bytes").isNotNull()).alias("on_disk"))
    absent = parts.join(parts_on_disk.select("path"), "path", "left_anti").select(*KEY).distinct()
    joined = (
        compared.join(baked_hours.select(*KEY, "bake_version"), KEY, "left")
        .join(absent.withColumn("part_missing", F.lit(True)), KEY, "left")
        .join(pruned_hours.select(*KEY).distinct(), KEY, "left_anti")
    )
    why = (
        F.when(F.col("bake_version").isNull() & F.col("on_disk"), "never_baked")
        .when(F.col("bake_version").isNull(), None)
        .when(F.col("bake_version") != bake_version, "version_stale")
        .when(F.col("part_missing"), "part_missing")
        .when(F.col("differs"), "segments_differ")
    )
    return joined.select(*KEY, why.alias("why")).where(F.col("why").isNotNull())


def bake_report(account: DataFrame, totals: DataFrame) -> DataFrame:
    """Records, failures and rows per hour."""
    left = account.groupBy("hour_label").agg(
        F.sum("records").alias("records"),
        F.sum(F.when(F.col("outcome") == "failure", F.col("records")).otherwise(0)).alias("failures"),
    )
    return left.join(totals, "hour_label", "left")
