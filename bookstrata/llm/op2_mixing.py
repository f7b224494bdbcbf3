"""Mixing sources to target weights by capped water-filling [native].

The wanted size is shared among the sources by weight, but no source may be repeated beyond ``epochs``.
Clamped sources keep ``epochs`` times their size and what they cannot take is shared anew among the others
by weight, until no source is above its limit. Each round reads one aggregate of a table with one row per
source and sends two numbers to the driver; the set of clamped sources only grows.

A source whose target is r times its size takes every document floor(r) times and fills the rest with
documents in a seeded order, the md5 of seed and doc_id: a document belongs to the fill if the running size
up to its middle stays within what is missing. So a source misses its target by at most half of one
document, and reruns agree. No source is gathered in one task: sizes are summed over 4,096 ranges of the md5 for
each source, and documents are put in order within one range only.

Defined results: a null text has size 0; null is a source of its own; a source or wanted size of 0 takes
nothing; documents of one source with equal id are put in order by size, and equal rows are
interchangeable; columns other than doc_id, text and source are ignored, or pass through if named. Texts are
read twice, for the sizes and to be placed; they are moved only if they are among the columns to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize, table, text_of, word_count

EPOCHS = 2
SHARE = 1.5
SEED = "mix-1"


def cycling_weights(rank: Column) -> Column:
    """Weights 3, 1, 2, repeating, by the rank (from 0) of the source in code-point order, null last."""
    return F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (rank % 3 + 1).cast("int"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` (one row per source) with ``rank`` from 0 in code-point order, null last.

    The rows are dealt by ranges, numbered within a range, and shifted by the rows of the ranges before; the
    written ranges are fixed before they are counted.
    """
    dealt = sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
    dealt = materialize(dealt.withColumn("piece", F.spark_partition_id()), "sources")
    within = Window.partitionBy("piece").orderBy(F.col("source").isNull(), "source")
    before = dealt.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # One row per range.
    before = before.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("row", F.row_number().over(within)).join(before, "piece")
    return ranked.select("name", "source", "source_size", (F.col("before") + F.col("row") - 1).alias("rank"))


def water_fill(sources: DataFrame, wanted: float, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    Ends when no source is above ``epochs`` times its size, or when all are at it: a wanted size beyond
    what the sources can give is not reached.
    """
    limit = (F.col("source_size") * epochs).cast("double")
    level, clamped = 0.0, -1
    while True:
        above = (F.col("weight") * F.lit(level) > limit) | (limit == 0)
        if clamped < 0:
            above = limit == 0
        full, weight, n = sources.agg(
            F.sum(F.when(above, limit).otherwise(0.0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
            F.count_if(above),
        ).first()
        if not weight or n == clamped:
            break
        level, clamped = (wanted - full) / weight, n
    if not weight:
        return sources.withColumn("target", limit)
    return sources.withColumn("target", F.when(above, limit).otherwise(F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    weights: Callable[[Column], Column] = cycling_weights,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
    name: str = "mixed",
) -> DataFrame:
    """One row per document: the columns ``keep`` and, as one column ``name``, size, source_size, target,
    repeats and taken. A column of that name is replaced.

    weights: from the rank of a source to its weight; share: wanted size as a multiple of all sizes.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    # A name for each source that is not null, so that joins and windows are dealt by the same columns.
    label = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    rows = docs.select(
        F.struct(*[c for c in keep if c != name]).alias("kept"),
        F.struct("doc_id").alias("own"),
        label.alias("name"),
        F.col("source").cast("string").alias("source"),
        word_count(text_of()).alias("size"),
        order.alias("h"),
    ).withColumn("bin", F.substring("h", 1, 3))

    bins = materialize(rows.groupBy("name", "source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sizes = bins.groupBy("name", "source").agg(F.sum("bin_size").alias("source_size"))
    sources = ranked_sources(sizes).withColumn("weight", weights(F.col("rank")))
    sources = materialize(sources, "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = water_fill(sources, share * total, epochs)

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate))
    sources = sources.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    # 4,096 rows a source at most.
    running = F.sum("bin_size").over(Window.partitionBy("name").orderBy("bin"))
    bins = bins.select("name", "bin", (running - F.col("bin_size")).alias("before"))
    bins = bins.join(sources.select("name", "source_size", "target", "whole", "missing"), "name")

    # Documents of one range of one source.
    ahead = Window.partitionBy("name", "bin").orderBy("h", "own", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("source").join(bins, ["name", "bin"]).withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    middle = F.col("before") + F.col("ahead") + F.col("size") / F.lit(2.0)
    repeats = F.col("whole") + ((middle <= F.col("missing")) & (F.col("size") > 0)).cast("long")
    placed = placed.withColumn("repeats", repeats).withColumn("taken", F.col("repeats") * F.col("size"))
    return placed.select("kept.*", F.struct("size", "source_size", "target", "repeats", "taken").alias(name))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", "mixed.taken")


ORACLE_TEMPLATE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
  md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
fill AS (SELECT 0 AS round, (SELECT {share} * sum(source_size) / sum(weight) FROM s WHERE source_size > 0) AS level
  UNION ALL SELECT round + 1, next FROM (SELECT round, level, ((SELECT {share} * sum(source_size) FROM s)
    - (SELECT coalesce(sum(source_size * {epochs}.0), 0) FROM s WHERE weight * level > source_size * {epochs}))
    / (SELECT sum(weight) FROM s WHERE weight * level <= source_size * {epochs} AND source_size > 0) AS next FROM fill)
  WHERE next > level),
t AS (SELECT source, source_size, least(weight * (SELECT max(level) FROM fill), source_size * {epochs}.0)::DOUBLE AS target FROM s),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS repeats FROM r)
"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {
    "op2_mixing": ORACLE_TEMPLATE.format(seed=SEED, docs="documents", share=SHARE, epochs=EPOCHS)
    + "SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken FROM m"
}
