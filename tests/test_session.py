from pyspark.sql import functions as F

from bookstrata.session import configure


def test_a_task_reads_a_small_share_of_a_shuffle(spark):
    """Some 48 MB of rows that do not pack are read in shares of 8 MB, not in one share for each of four cores."""
    configure(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), F.xxhash64("id", F.lit(1)).alias("v"))
        assert rows.groupBy("k").agg(F.max("v")).rdd.getNumPartitions() >= 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_shares_do_not_depend_on_the_sessions_number_of_shuffle_partitions(spark):
    """The same rows with four shuffle partitions: shares stay small, and a few rows are one share."""
    configure(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    rows = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), F.xxhash64("id", F.lit(1)).alias("v"))
    assert rows.groupBy("k").agg(F.max("v")).rdd.getNumPartitions() >= 6
    assert rows.limit(100).groupBy("k").agg(F.max("v")).rdd.getNumPartitions() == 1
