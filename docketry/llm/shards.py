"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters records over buckets that fit in memory by a seeded hash of
their id; a bucket of more than twice the bound is split by a hash of the rows'
places in the input. A bucket is one partition of the exchange. Pass 2 sorts a bucket, so
that a repeated task sees the same order, permutes it with Spark's seeded
``shuffle`` (a Fisher-Yates shuffle, seeded anew in every partition) and writes
it. Buckets laid end to end are one random order of all rows; shard ``s`` of
``S`` takes the positions from ``ceil(s*N/S)``, so counts differ by one at most
(the law ``rows``).

Scale: whole records cross the network once. The number of buckets follows the
bytes; it ends at ``max_buckets`` (2**20), which bounds the table of bucket
offsets that is broadcast (16 bytes a row); beyond 16 TB buckets grow instead,
to 100 MB at 100 TB. Bytes of all columns count. Null ids and rows of one
repeated id are spread over the parts of their bucket; that needs an input which
is read in the same order each time, as files are, and fails where it is not.

Edge cases: a null text counts 16 bytes; an empty table writes no rows; all columns of a record,
whatever their names, are kept inside the struct ``record``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import running_starts

BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def whole_size(records: DataFrame) -> Column:
    """About the bytes of a record: strings by their length, 16 for any column."""
    size = F.lit(0).cast("long")
    for field in records.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            value = F.lit("")
        size = size + record_size(value)
    return size


def split_buckets(records: DataFrame, bucket: Column, buckets: int, bound: int) -> tuple[DataFrame, int]:
    """The records with their ``bucket`` inside (record, bucket), and the number of buckets."""
    rows = records.select(
        F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"), bucket.alias("bucket")
    )
    heavy = (
        records.groupBy(bucket.alias("bucket"))
        .agg(F.sum(whole_size(records)).alias("bytes"))
        .where(F.col("bytes") > 2 * bound)
        .orderBy("bucket")
        .collect()  # at most one for each 2 * bound bytes
    )
    if not heavy:
        return rows, buckets
    table, end = [], buckets
    for r in heavy:
        parts = math.ceil(r["bytes"] / bound)
        table.append((r["bucket"], end, parts))
        end += parts
    split = records.sparkSession.createDataFrame(table, "heavy int, first int, parts int")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("place")), F.col("parts")).cast("int")
    dealt = (
        rows.withColumn("place", F.monotonically_increasing_id())
        .join(F.broadcast(split), F.col("bucket") == F.col("heavy"), "left")
        .select("record", F.coalesce(F.col("first") + part, F.col("bucket")).alias("bucket"))
    )
    return dealt, end


def shuffle_into_shards(
    records: DataFrame,
    path: str,
    shards: int = 40,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    max_buckets: int = MAX_BUCKETS,
) -> DataFrame:
    """Write (shard, slot, record) below ``path``, by shard, and read it back."""
    total = records.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(whole_size(records)).alias("bytes")
    ).first()
    rows = total["rows"]
    buckets = min(max_buckets, max(1, math.ceil((total["bytes"] or 0) / bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)).cast("int")
    bound = max(bucket_bytes, math.ceil((total["bytes"] or 0) / buckets))
    dealt, buckets = split_buckets(records, bucket, buckets, bound)
    counts = dealt.groupBy("bucket").count()
    offsets = running_starts(counts, "bucket", "count").join(
        counts.select(F.col("bucket").alias("of_place"), "count"), "of_place"
    )
    scattered = (
        dealt.select(
            "bucket",
            F.xxhash64(F.lit(seed), F.lit("order"), F.col(f"record.`{key}`")).alias("order"),
            "record",
        )
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions(
            "bucket", "order", F.col(f"record.`{key}`"), F.crc32(F.col(f"record.`{text}`"))
        )
    )
    n = max(rows, 1)
    placed = (
        scattered.groupBy("bucket")
        .agg(F.collect_list("record").alias("records"))
        .join(F.broadcast(offsets), F.col("bucket") == F.col("of_place"), "left")
        .withColumn(
            "before",
            F.when(F.size("records") == F.col("count"), F.col("before")).otherwise(
                F.raise_error(F.lit("the input was read in another order")).cast("long")
            ),
        )
        .select("before", F.posexplode(F.shuffle("records", F.lit(seed))).alias("position", "record"))
        .select((F.col("before") + F.col("position")).cast("long").alias("place"), "record")
        .withColumn("shard", F.expr(f"CAST(place * {shards} div {n} AS INT)"))
    )
    first = F.expr(f"(shard * BIGINT({n}) + {shards - 1}) div {shards}")
    (
        placed.select("shard", (F.col("place") - first).alias("slot"), "record")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
    spark = records.sparkSession
    schema = "slot long, record struct<{}>, shard int".format(
        ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in records.schema.fields)
    )
    return spark.read.schema(schema).parquet(path)
