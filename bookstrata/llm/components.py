"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookstrata.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """id, label of every id that ``links`` (a bigint, b bigint) names; label is the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label's own label, so long chains
    shorten by powers of two. Labels are written to the shared folder each round, which cuts the lineage;
    only the number of changed rows reaches the driver. A hot id is a key with many rows on one side of a
    join only, which adaptive execution splits, and of an aggregation with partial sums.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "edges")
    first = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = materialize(first, "labels")
    while True:
        at = labels.select(F.col("id").alias("b"), "label")
        near = edges.join(at, "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        lower = lower.join(of, "label").select(
            "id", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("old")).alias("changed")
        )
        lower = materialize(lower, "labels")
        labels = lower.select("id", "label")
        if not lower.agg(F.count_if("changed")).first()[0]:
            return labels
