"""Running the streaming forms: sources, sinks and incremental jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookstrata.functions.exact import floor_div
from bookstrata.operators.sequences import bus_continuity
from bookstrata.session import configure, scratch_path


def run_available(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process everything available, then return what was written, as a batch DataFrame.

    Output is files under the shared folder, so results survive the loss of executors and never pass
    through the driver.
    """
    out = out or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder, or one Parquet file, as a stream."""
    configure(spark)
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A file source watches a folder, so one file is picked out of its folder by name.
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def keep_latest(spark: SparkSession, stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> None:
    """Maintain a table of the last row per key: each batch is merged with what is stored.

    The merged table is written beside the old one and only then named current, so a failed batch is
    simply repeated.
    """
    rest = [c for c in stream.columns if c != key]

    def merge(batch: DataFrame, number: int) -> None:
        current = f"{path}/v{number}"
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{path}/v{number - 1}"))
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        latest.select(*stream.columns).write.mode("overwrite").parquet(current)

    run_batches(stream, merge, checkpoint)


# Arrival numbers of one block, which one task judges in order.
BUS_BLOCK = 4_096
_BUS_OUT = "publisher string, arrival bigint, bus_epoch bigint, bus_seq bigint, reset string, missed bigint, generation bigint, body string"
_BUS_HELD = "publisher string, bus_epoch bigint, bus_seq bigint, generation bigint"


def follow_long_bus(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """As ``state.follow_bus``, for micro-batches too large for one task, run until everything available is processed.

    A publisher is one key, so a batch of it is judged in blocks of arrivals, all at the same time. Between batches
    one row for each publisher is held: its last message and generation. It goes before the next batch's rows
    as a message of generation 1. Every batch writes folders of its own number, so a failed one is simply repeated.
    """
    out = out or scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-state")
    held = f"{checkpoint}-held"
    spark.createDataFrame([], _BUS_OUT).write.mode("ignore").parquet(f"{out}/none")
    spark.createDataFrame([], _BUS_HELD).write.mode("ignore").parquet(f"{held}/v-1")

    def judge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(_BUS_HELD).parquet(f"{held}/v{number - 1}")
        fresh = batch.select("publisher", "arrival", "bus_epoch", "bus_seq", "body", F.lit(1).alias("fresh"), floor_div("arrival", BUS_BLOCK).alias("block"))
        last = before.select("publisher", "bus_epoch", "bus_seq", F.lit(0).alias("fresh"), F.lit(0).cast("bigint").alias("block"))
        rows = fresh.unionByName(last, allowMissingColumns=True)
        rows = bus_continuity(rows, ["publisher"], ["fresh", "block"], ["arrival"]).where("fresh = 1")
        since = before.select("publisher", (F.col("generation") - 1).alias("since"))
        rows = rows.join(since, "publisher", "left").withColumn("generation", F.col("generation") + F.coalesce("since", F.lit(0)))
        written = f"{out}/v{number}"
        rows.select(*[c.split()[0] for c in _BUS_OUT.split(", ")]).write.mode("overwrite").parquet(written)
        latest = session.read.schema(_BUS_OUT).parquet(written).groupBy("publisher").agg(
            F.max_by(F.struct("bus_epoch", "bus_seq", "generation"), "arrival").alias("r")
        ).select("publisher", "r.*")
        kept = latest.unionByName(before.join(latest.select("publisher"), "publisher", "left_anti"))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{held}/v{number}")

    run_batches(stream, judge, checkpoint)
    return spark.read.schema(_BUS_OUT).option("recursiveFileLookup", "true").parquet(out)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def route(messages: DataFrame, tracked: DataFrame) -> DataFrame:
    """Messages of tracked markets only: a stream joined to a static table."""
    return messages.join(tracked.select("ticker"), "ticker", "left_semi")
