"""Bounded personal re-ranking of a fixed candidate list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators import ranking as rk

#: The largest share by which a preference may raise a candidate.
MAX_GAMMA = 0.30


def query_relevance(df: DataFrame, query: str) -> DataFrame:
    """Adds q: the min-max of baseline_score per query; if all are equal, (n - baseline_rank + 1) / n."""
    b = df.groupBy(query).agg(F.min("baseline_score").alias("_lo"), F.max("baseline_score").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    lo, hi, n = F.col("_lo"), F.col("_hi"), F.col("_n")
    q = F.when(lo == hi, (n - F.col("baseline_rank") + 1) / n).otherwise((F.col("baseline_score") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.join(b, query).withColumn("q", q).drop("_lo", "_hi", "_n")


def channel_norm(df: DataFrame, query: str, signal: str) -> DataFrame:
    """Adds <signal>_norm (0 if missing, 1 if all equal) and <signal>_available (whether the query has the signal at all)."""
    b = df.groupBy(query).agg(F.min(signal).alias("_lo"), F.max(signal).alias("_hi"))
    norm = F.when(F.col(signal).isNull(), 0.0).otherwise(rk.minmax(F.col(signal), F.col("_lo"), F.col("_hi")))
    return df.join(b, query).withColumn(f"{signal}_norm", norm).withColumn(f"{signal}_available", F.col("_lo").isNotNull()).drop("_lo", "_hi")


def signal_weights(weights: dict[str, float], available: dict[str, Column]) -> dict[str, Column]:
    """Weights over the available signals: scaled to sum to 1; shared evenly if all of them weigh 0; 0 for the others."""
    total = sum((F.when(available[s], w).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    n = sum((F.when(available[s], 1.0).otherwise(0.0) for s in weights), F.lit(0.0))
    return {s: F.when(~available[s], 0.0).when(total > 0, F.lit(float(w)) / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.nullif(n, F.lit(0.0))) for s, w in weights.items()}


def gated(q: Column, preference: Column, gamma: float) -> Column:
    """q * (1 + gamma * preference), the preference clamped to 0..1."""
    if not 0 <= gamma <= MAX_GAMMA:
        raise ValueError(f"gamma must lie in 0..{MAX_GAMMA}")
    return q * (1 + F.lit(float(gamma)) * F.least(F.greatest(preference, F.lit(0.0)), F.lit(1.0)))


def rerank(df: DataFrame, query: str, item: str, weights: dict[str, float], gamma: float) -> DataFrame:
    """df with q, preference, final and rank: final descending, baseline_rank, item. Without any signal the baseline order stays. The
    candidates are the same before and after."""
    d = query_relevance(df, query)
    for s in weights:
        d = channel_norm(d, query, s)
    w = signal_weights(weights, {s: F.col(f"{s}_available") for s in weights})
    preference = sum((w[s] * F.col(f"{s}_norm") for s in weights), F.lit(0.0))
    d = d.withColumn("preference", F.coalesce(preference, F.lit(0.0))).withColumn("final", F.round(gated(F.col("q"), F.col("preference"), gamma), 9))
    order = rk.W.partitionBy(query).orderBy(F.col("final").desc(), "baseline_rank", item)
    any_signal = F.lit(False)
    for s in weights:
        any_signal = any_signal | F.col(f"{s}_available")
    return d.withColumn("rank", F.when(any_signal, F.row_number().over(order)).otherwise(F.col("baseline_rank")).cast("bigint"))
