"""Exact quantiles per key that hold up when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUE = "decimal(18,2)"
RESULT = "decimal(20,4)"


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percent: int,
    name: str,
    bucket_width: int = 100,
) -> DataFrame:
    """The ``percent`` quantile of ``value`` (two decimals) per key, with linear
    interpolation between neighbours.

    Equal values are counted first (partially, before the shuffle, on key and
    value). Counts per value range then tell which one or two ranges hold the
    wanted ranks, and only those are looked at value by value. No task sees
    more of a key than its value ranges, or the cents within one range.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, F.col(value).cast(VALUE).alias("_value"))
        .where("_value IS NOT NULL")
        .groupBy(*keys, "_value")
        .agg(F.count("*").alias("_n"))
        .withColumn("_range", F.floor(F.col("_value") / bucket_width))
    )
    by_range = Window.partitionBy(*keys).orderBy("_range")
    per_range = (
        counted.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_in_range"))
        .withColumns(
            {
                "_upto": F.sum("_in_range").over(by_range.rowsBetween(Window.unboundedPreceding, 0)),
                "_total": F.sum("_in_range").over(Window.partitionBy(*keys)),
            }
        )
        .selectExpr(
            *keys, "_range", "_upto - _in_range AS _before", "_upto",
            f"((_total - 1) * {percent}) div 100 AS _low",
            f"((_total - 1) * {percent}) % 100 AS _rest",
        )
        .withColumn("_high", F.col("_low") + F.when(F.col("_rest") > 0, 1).otherwise(0))
        .where(
            "(_before <= _low AND _low < _upto) OR (_before <= _high AND _high < _upto)"
        )
    )
    by_value = Window.partitionBy(*keys, "_range").orderBy("_value")
    ranked = (
        counted.join(per_range, [*keys, "_range"], "inner")
        .withColumn(
            "_end",
            F.col("_before") + F.sum("_n").over(by_value.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )

    def at(rank: str):
        return F.max(F.when((F.col("_begin") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_value")))

    return (
        ranked.groupBy(*keys)
        .agg(at("_low").alias("_at_low"), at("_high").alias("_at_high"), F.max("_rest").alias("_share"))
        .select(
            *keys,
            (
                F.col("_at_low").cast(RESULT)
                + ((F.col("_at_high") - F.col("_at_low")) * F.col("_share").cast("decimal(3,0)") / 100)
            ).cast(RESULT).alias(name),
        )
    )
