"""Consecutive numbers in sorted order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrine.plans.storage import materialize


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with their 0-based position in byte order of ``column``. Rows are cut into ranges at values of the column, each range is
    numbered by itself, and the ranges' sizes (one row each, at most 2,048) give the offsets."""
    n = max(1, min(2_048, df.sparkSession.sparkContext.defaultParallelism * 4))
    ranged = materialize(df.repartitionByRange(n, column).withColumn("_range_p", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_range_r", F.row_number().over(W.partitionBy("_range_p").orderBy(column)))
    sizes = ranged.groupBy("_range_p").agg(F.count(F.lit(1)).alias("_range_n"))
    offsets = sizes.withColumn("_range_o", F.coalesce(F.sum("_range_n").over(W.orderBy("_range_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range_p", "_range_o")
    return local.join(F.broadcast(offsets), "_range_p").withColumn(name, F.col("_range_o") + F.col("_range_r") - 1).drop("_range_p", "_range_r", "_range_o")
