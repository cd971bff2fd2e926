"""Streams of events: windows, late rows, overlapping reads, incremental upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from tidemark.operators.sinks import path_exists
from tidemark.operators.versioned import BUCKETS, VersionedTable
from tidemark.session import scratch_path

SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()),
    StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("props", StringType()),
])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern also fits a single Parquet file."""
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def once_per_key(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Rows of a stream that re-reads an overlap: a key that comes again within the delay is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, delay: str) -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than the delay no longer change a window."""
    by = stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return by.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def stream_root(spark: SparkSession, name: str) -> str:
    """A folder of its own for a stream that is run once; one that is to resume gets a fixed root from its caller."""
    return scratch_path(spark, name)


def run_batches(stream: DataFrame, root: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there now, from the checkpoint under ``root`` on.

    A second call with the same root goes on after the last finished batch. A
    batch that failed half way runs again under its number, so ``each`` must
    write what it writes under that number.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(each)
    writer.start().awaitTermination()


def written(spark: SparkSession, path: str, schema: StructType, last: bool = False) -> DataFrame:
    """What the batches wrote under ``path``; with ``last`` only the latest batch, as for complete output."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    if last:
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar())
    return rows.drop("batch")


def drain(stream: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, and read all that it has written so far."""
    spark, root = stream.sparkSession, root or stream_root(stream.sparkSession, "stream")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run_batches(stream, root, mode, each)
    return written(spark, f"{root}/out", stream.schema, mode == "complete")


def split_late(stream: DataFrame, at: str, delay_days: int, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time and rows that came too late: the late ones go to a table of their own, none is lost.

    A row is late if it is older than the latest row of the batches before its
    own by more than the delay. That mark is written with each batch, so that a
    batch that runs again is judged like the first time.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        marks = written(batch.sparkSession, f"{root}/marks", StructType([StructField("mark", TimestampType())]))
        if path_exists(batch.sparkSession, f"{root}/marks"):
            marks = batch.sparkSession.read.parquet(f"{root}/marks").where(F.col("batch") < number)
        mark = marks.agg(F.max("mark")).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col(at) < F.lit(mark) - F.expr(f"INTERVAL {delay_days} DAYS"), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        batch.agg(F.max(at).cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")

    run_batches(stream, root, "append", each)
    return written(spark, f"{root}/out", stream.schema), written(spark, f"{root}/late", stream.schema)


def latest_by_upsert(stream: DataFrame, keys: list[str], order: str, root: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Keep the latest row of each key in a versioned table that each batch is merged into."""
    table = VersionedTable(stream.sparkSession, root or stream_root(stream.sparkSession, "table"), stream.schema, tuple(keys), buckets)
    run_batches(stream, table.root, "append", lambda batch, number: table.write(batch, number, [F.desc(order)]))
    return table.read().select(*stream.columns)


def insert_ignored(stream: DataFrame, keys: list[str], order: str, root: str, buckets: int = BUCKETS) -> DataFrame:
    """Keep the row of each key that came first, whatever is read again; within a batch the least by ``order``."""
    table = VersionedTable(stream.sparkSession, root, stream.schema, tuple(keys), buckets)
    run_batches(stream, root, "append", lambda batch, number: table.write(batch, number, [F.asc(order)], ignore=True))
    return table.read().select(*stream.columns)
