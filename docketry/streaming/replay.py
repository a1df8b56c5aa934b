"""File-source streams that end by themselves, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event time of the marker row that closes the last windows of a replay.
MARKER_TIME = "2200-01-01 00:00:00"


def table_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream; ``path`` may be one file or a folder.

    Without a limit a replay is one micro-batch, in which no row is late. With
    a limit the files should arrive in event-time order.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # As a glob the path may name a single file, too.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def with_closing_marker(stream: DataFrame, event_time: str, folder: str) -> DataFrame:
    """Append one row far in the future (all else NULL) to a replay that ends for good.

    It moves the watermark past every real window, so a table can be replayed
    to its last window. The checkpoint keeps that watermark: never use it on a
    folder that a later run goes on with, whose new rows would all be late.
    Remove its results from the stored rows, not in the stream: a filter would
    be pushed below the watermark.
    """
    spark = stream.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema])
    path = f"{folder}/marker"
    columns = [
        F.lit(MARKER_TIME if f.name == event_time else None).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    spark.range(1).select(*columns).write.mode("overwrite").parquet(path)
    return stream.unionByName(spark.readStream.schema(schema).parquet(path))


def run_to_folder(
    stream: DataFrame,
    folder: str,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run to the end of the available input and return the stored rows.

    ``each`` is applied to every micro-batch as a table before it is stored.

    Each micro-batch overwrites a folder of its own, so a repeated one leaves
    no duplicates. ``epoch`` tells them apart.
    """
    rows = f"{folder}/rows"
    spark = stream.sparkSession
    each = each or (lambda batch: batch)
    shape = each(spark.createDataFrame([], stream.schema)).schema
    empty = T.StructType([*shape.fields, T.StructField("epoch", T.LongType())])

    def save(batch: DataFrame, epoch: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{rows}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(empty).parquet(rows)


def run_to_state(stream: DataFrame, folder: str) -> None:
    """Run an aggregating stream to the end of the available input; only its state
    is kept."""
    query = (
        stream.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """The state of the last micro-batch that was committed: (key, value, partition_id)."""
    return spark.read.format("statestore").load(f"{folder}/checkpoint")


def stored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """What ``run_to_folder`` has stored, as a stream of its own, with the epoch of
    each row. Rows of an epoch that was repeated may come twice."""
    rows = f"{folder}/rows"
    schema = spark.read.parquet(rows).drop("epoch").schema
    stream = spark.readStream.schema(schema).parquet(f"{rows}/epoch=*")
    return stream.withColumn(
        "epoch", F.regexp_extract("_metadata.file_path", r"/epoch=(\d+)/[^/]+$", 1).cast("long")
    )
