"""Per-key results when a few keys hold most rows.

Rows are grouped by (key, value) before they are grouped by key. The first grouping spreads a hot key over as many tasks as it has
values, the second sees each (key, value) once with its weight, and both combine on the map side. Counts, distinct counts, modes and
percentiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Order-preserving buckets per unit of asinh(value) that percentiles are located in before rows are ordered.
BUCKETS_PER_UNIT = 64


def compress(df: DataFrame, key: str, value: str, latest: str | None = None) -> DataFrame:
    """One row per (key, value) with its weight: columns key, value, weight (bigint) and, with ``latest``, the largest of that column.

    Null keys are left out, a null value is a value of its own, an empty table gives no rows. Other columns are not read.
    """
    cols = [F.col(key).alias("key"), F.col(value).alias("value")]
    if latest:
        cols.append(F.col(latest).alias("at"))
    aggs = [F.count(F.lit(1)).alias("weight")]
    if latest:
        aggs.append(F.max("at").alias("latest"))
    return df.select(*cols).where(F.col("key").isNotNull()).groupBy("key", "value").agg(*aggs)


def key_totals(compressed: DataFrame) -> DataFrame:
    """Per key of compress(): n_rows, n_distinct (non-null values) and, if it is there, the latest."""
    aggs = [F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct")]
    if "latest" in compressed.columns:
        aggs.append(F.max("latest").alias("latest"))
    return compressed.groupBy("key").agg(*aggs)


def key_mode(compressed: DataFrame) -> DataFrame:
    """Per key the non-null value of the largest weight (ties: the smallest value) as ``mode`` with ``mode_weight``.

    Keys with null values only have no row.
    """
    best = F.min(F.struct((-F.col("weight")).alias("w"), "value"))
    return compressed.where(F.col("value").isNotNull()).groupBy("key").agg(best.alias("best")).select("key", F.col("best.value").alias("mode"), (-F.col("best.w")).alias("mode_weight"))


def key_percentile(compressed: DataFrame, share: float) -> DataFrame:
    """Per key the exact lower percentile of its finite values (the smallest value whose cumulated weight reaches share * total).

    No task orders all values of a key: weights are summed by an order-preserving bucket of the value, the bucket that holds the wanted
    weight is found from at most ~91,000 bucket sums, and only that bucket's distinct values are ordered.
    """
    v = F.col("value").cast("double")
    finite = compressed.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).select("key", v.alias("value"), "weight").withColumn("bucket", F.floor(F.asinh("value") * BUCKETS_PER_UNIT))
    sums = finite.groupBy("key", "bucket").agg(F.sum("weight").alias("w"))
    upto = W.partitionBy("key").orderBy("bucket")
    located = (
        sums.withColumn("cum", F.sum("w").over(upto.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("total", F.sum("w").over(W.partitionBy("key")))
        .withColumn("want", F.ceil(F.col("total") * F.lit(share)))
        .withColumn("want", F.greatest(F.col("want"), F.lit(1)))
        .where((F.col("cum") >= F.col("want")) & (F.col("cum") - F.col("w") < F.col("want")))
        .select("key", "bucket", (F.col("want") - F.col("cum") + F.col("w")).alias("left"))
    )
    inner = W.partitionBy("key", "bucket").orderBy("value")
    return (
        finite.join(located, ["key", "bucket"])
        .withColumn("cum", F.sum("weight").over(inner.rowsBetween(W.unboundedPreceding, 0)))
        .where(F.col("cum") >= F.col("left"))
        .groupBy("key")
        .agg(F.min("value").alias("percentile"))
    )


def per_key(df: DataFrame, key: str, partner: str, occurred: str, kind: str, amount: str) -> DataFrame:
    """One row per non-null key: n_rows, n_partners (distinct non-null), latest, top_kind (most frequent, ties: smallest) and median_amount
    (lower median of the finite amounts, null without any). Repeated rows count as rows."""
    totals = key_totals(compress(df, key, partner, occurred)).withColumnRenamed("n_distinct", "n_partners")
    mode = key_mode(compress(df, key, kind)).select("key", F.col("mode").alias("top_kind"))
    median = key_percentile(compress(df, key, amount), 0.5).select("key", F.col("percentile").alias("median_amount"))
    return totals.join(mode, "key", "left").join(median, "key", "left")


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Values of each column in ``keys`` that at least ``share`` of all rows hold: columns field, key_value, n_rows.

    With two columns the rows are first compressed to (first, second, weight), so neither a hot value of one nor of the other gathers in a
    task. Null is no value, but its rows count among all rows.
    """
    pairs = df.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("weight"))
    entries = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"k{i}").alias("key_value")) for i, k in enumerate(keys)])
    per = pairs.select(F.explode(entries).alias("e"), "weight").select("e.field", "e.key_value", "weight").groupBy("field", "key_value").agg(F.sum("weight").alias("n_rows"))
    # every row has one entry per field, so the rows of one field add up to all rows
    total = per.where(F.col("field") == keys[0]).agg(F.sum("n_rows").alias("all_rows"))
    return per.where(F.col("key_value").isNotNull()).crossJoin(F.broadcast(total)).where(F.col("n_rows") >= share * F.col("all_rows")).select("field", "key_value", "n_rows")


def hot_values(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys that hold at least a 1/most part of the rows with a key: at most ``most`` rows, which bounds what is broadcast of them."""
    sizes = df.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).where(F.col("n") * F.lit(most) >= F.col("total")).select("key", "n")


def salt(column: Column, salts: int) -> Column:
    """A stable salt from 0 to salts - 1 by the hash of a column."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")
