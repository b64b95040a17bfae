"""Ranks, top-k, normalisation and orderings within a query. Scores are ordered descending, ties by identifier ascending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def ranked(df: DataFrame, keys: Sequence[str], score: str, item: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based position (bigint) within the keys."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), item)
    return df.withColumn(name, F.row_number().over(order).cast("bigint"))


def top_k(df: DataFrame, keys: Sequence[str], score: str, item: str, k: int) -> DataFrame:
    """The k best finite rows within the keys, each item once with its best score. The limit is applied per task before the shuffle."""
    best = df.where(finite(F.col(score))).groupBy(*keys, item).agg(F.max(score).alias(score))
    return ranked(best, keys, score, item).where(F.col("rank") <= k)


def candidate_depth(top_k: int, configured: int | None = None, maximum: int = 500) -> int:
    """How many candidates to fetch per channel for a final top_k."""
    return min(maximum, max(top_k, configured if configured is not None else max(100, 5 * top_k)))


def minmax(score: Column, lo: Column, hi: Column) -> Column:
    """Scaled to 0..1; all equal gives 1."""
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / F.nullif(hi - lo, F.lit(0.0)))


def with_minmax(df: DataFrame, keys: Sequence[str], score: str, name: str = "norm") -> DataFrame:
    """Adds the min-max of a score within the keys. The bounds are aggregated, not windowed: a hot key combines on the map side."""
    bounds = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.join(bounds, list(keys)).withColumn(name, minmax(F.col(score), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def hidden_rank(scores: DataFrame, hidden: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """keys, hidden, rank of one hidden item per key: 1 + items that score higher or tie with a smaller identifier. Null without a score."""
    target = hidden.select(*keys, F.col(item).alias("hidden")).join(scores.select(*keys, F.col(item).alias("hidden"), F.col(score).alias("_h")), [*keys, "hidden"], "left")
    both = scores.join(target, list(keys))
    better = (F.col(score) > F.col("_h")) | ((F.col(score) == F.col("_h")) & (F.col(item) < F.col("hidden")))
    counted = both.groupBy(*keys, "hidden").agg(F.max("_h").alias("_h"), F.count(F.when(better, 1)).alias("n"))
    return counted.select(*keys, "hidden", F.when(F.col("_h").isNotNull(), F.col("n") + 1).alias("rank"))


def nearest_rank(values: Column, share: float) -> Column:
    """The element at index round-half-even(share * (n - 1)) of the sorted array."""
    s = F.array_sort(values)
    return F.get(s, F.bround(F.lit(share) * (F.size(s) - 1), 0).cast("int"))


def movement(base: DataFrame, moved: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Per key, of two rankings (rank) of the same items: mean and largest movement, promotions, demotions and the overlap of the first ten."""
    both = base.select(*keys, item, F.col("rank").alias("b")).join(moved.select(*keys, item, F.col("rank").alias("m")), [*keys, item])
    shift = F.col("b") - F.col("m")
    old, new = F.col("b") <= 10, F.col("m") <= 10
    common, any_ = F.count(F.when(old & new, 1)), F.count(F.when(old | new, 1))
    return both.groupBy(*keys).agg(
        F.avg(F.abs(shift)).alias("mean_movement"), F.max(F.abs(shift)).alias("max_movement"), F.max(shift).alias("max_promotion"),
        F.count(F.when(shift > 0, 1)).alias("improved"), F.count(F.when(shift < 0, 1)).alias("worsened"), common.alias("overlap10"), F.coalesce(common / F.nullif(any_, F.lit(0)), F.lit(0.0)).alias("jaccard10"),
    )
