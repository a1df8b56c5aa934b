"""What the operators share: table paths, ASCII case, the words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.session import configure

# Rows that cross to Python at once: bounds its memory where texts are long.
BATCH_ROWS = "500"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def ascii_lower_bytes(text: str | None) -> bytes:
    """The same in Python: UTF-8 keeps ASCII bytes to themselves."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def id_remainder(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def content_of(*values: Column) -> Column:
    """128 bits that stand for the values: two hashes; null counts as a value."""
    tagged = [part for v in values for part in (v, v.isNull())]
    return F.concat_ws(":", F.xxhash64(*tagged).cast("string"), F.xxhash64(F.lit(7), *tagged).cast("string"))


def running_starts(amounts: DataFrame, place: str, amount: str, block: int = 1024) -> DataFrame:
    """(of_place, before): the sum of ``amount`` over all smaller places.

    One row for each place, numbered from 0. Places are summed in blocks, so only
    one row of a thousand meets in a single task.
    """
    blocked = amounts.select(place, amount, F.floor(F.col(place) / block).alias("block"))
    earlier = Window.orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy(F.col("block").alias("of_block"))
        .agg(F.sum(amount).alias("whole"))
        .select("of_block", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("before_block"))
    )
    within = Window.partitionBy("block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("inside", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(blocks, F.col("block") == F.col("of_block"))
        .select(F.col(place).alias("of_place"), (F.col("before_block") + F.col("inside")).alias("before"))
    )
