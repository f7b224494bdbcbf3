"""A training corpus in five stages; each is written as Parquet and read again as the next one's documents.

1. language: documents whose language is und, or that are too far from every centroid, go.
2. lines: repeated three-line windows are cut out of later documents; documents left without any line go.
3. near_duplicates: one document of each class of near duplicates stays.
4. mix: documents are dropped, kept or repeated so that sources come near their target weights.
5. pieces: each document's token ids and the text they decode to.

Stages 1 to 4 return the columns of their documents; ``n_chars`` follows the text where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.llm import op2_mixing, op4_language, op5_pieces, op7_lines, op8_near
from bookstrata.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; training leaves out the held-out quarter, as the query does."""
    model = op4_language.fit(docs.where(~op4_language.held_out()))
    names = ("_stage_lang", "_stage_score", "_stage_rejected")
    return op4_language.identify(docs, model, docs.columns, names).where(~F.col(names[2])).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated windows; one that consisted of them, or has no line with a word, goes."""
    names = ("_stage_lines", "_stage_removed")
    left = op7_lines.dedup_lines(docs, names).where(F.col(names[0]) > F.col(names[1]))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    key = F.concat_ws(":", op8_near.digest(), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    kept = op8_near.near_duplicates(docs).where("kept")
    kept = kept.select(F.concat_ws(":", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_stage_key"))
    rows = docs.withColumn("_stage_key", key).join(kept, "_stage_key")
    # Rows equal in id and text have one key; of these the one with the lowest other columns stays.
    least = rows.groupBy("_stage_key").agg(F.min(F.struct(*docs.columns)).alias("_stage_row"))
    return least.select("_stage_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = op2_mixing.mix(docs, tuple(docs.columns), name="_stage_mixed").where("_stage_mixed.repeats > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("_stage_mixed.repeats").cast("int")))
    return mixed.withColumn("_stage_copy", times).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of each document of the mix."""
    encoded = op5_pieces.encode(docs.select(F.col("doc_id").alias("key"), "text"), ids=True)
    return encoded.select(F.col("key").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pieces", pieces),
]

# Nearest centroids and merges of pieces are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None

# Rows of whole documents that are held at a time on either side of a Python worker; every stage takes rows one by one.
BATCH_ROWS = 1_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        for name, stage in STAGES:
            folder = scratch_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(folder)
            docs = spark.read.parquet(folder)
    finally:
        spark.conf.set(setting, before)
    return docs
