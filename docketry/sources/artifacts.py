"""Step results as JSON files, keyed by step, run and document.

A run writes its own partition, so re-running it replaces what it wrote and
nothing else; the newest run of a document wins on reading.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTIFACT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("run", T.LongType()),
    ]
)

RECORDS_IN_A_FILE = 250_000


def artifact_rows(results: DataFrame, steps: dict[str, list[str] | None]) -> DataFrame:
    """(doc_id, body, step): for each step of a result row one JSON object of doc_id and
    the step's columns, all columns if None. The row is read once for all its steps.
    A step whose columns are all NULL has no object."""

    def entry(step: str, columns: list[str] | None) -> Column:
        body = F.to_json(F.struct("*") if columns is None else F.struct("doc_id", *columns))
        there = reduce(or_, [F.col(c).isNotNull() for c in columns]) if columns else F.lit(True)
        return F.when(there, F.struct(body.alias("body"), F.lit(step).alias("step")))

    entries = F.array_compact(F.array(*[entry(step, columns) for step, columns in steps.items()]))
    return results.select("doc_id", F.explode(entries).alias("_entry")).select("doc_id", "_entry.*")


def write_artifact_rows(rows: DataFrame, path: str, run: int = 0) -> None:
    """One write for any number of steps; each of these steps of the run is replaced.

    The files are compressed, in pieces of ``RECORDS_IN_A_FILE``: names and quoting of
    the JSON make up most of a body, and a compressed file is read by one task."""
    (
        rows.select("doc_id", "body", "step", F.lit(run).alias("run"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("step", "run")
        .option("maxRecordsPerFile", RECORDS_IN_A_FILE)
        .json(path, compression="gzip")
    )


def write_step_artifacts(results: DataFrame, step: str, path: str, run: int = 0) -> None:
    """Write every row of a step's result as one JSON object."""
    write_artifact_rows(artifact_rows(results, {step: None}), path, run)


def read_step_artifacts(
    spark: SparkSession, path: str, step: str | None = None, body: Column | None = None
) -> DataFrame:
    """The newest body per step and document.

    ``body``, of the columns doc_id, body, step and run, is returned in its place:
    worked out where the files are read, so what it leaves out is not shuffled."""
    stored = spark.read.schema(ARTIFACT_SCHEMA).json(path)
    if step is not None:
        stored = stored.where(F.col("step") == step)
    if body is not None:
        stored = stored.withColumn("body", body)
    newest = Window.partitionBy("step", "doc_id").orderBy(F.desc("run"))
    return stored.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """How many documents each step has results of."""
    return read_step_artifacts(spark, path, body=F.lit(None)).groupBy("step").agg(F.count("*").alias("documents"))
