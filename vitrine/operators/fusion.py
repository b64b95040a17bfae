"""Fusion of ranked channels, the same for search and recommendations: any number of channels in long form.

``ranked``: query, item, channel, score, rank (one row per candidate and channel). A channel that a query lacks altogether is unavailable;
a candidate that a channel lacks contributes 0 there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators import ranking as rk

K0 = 60.0


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Non-negative weights that sum to 1 within 1e-6, or ValueError."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("channel weights must be non-negative and sum to 1")
    return weights


def weight_of(weights: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("channel")]


def rrf(ranked: DataFrame, query: str, item: str, k0: float = K0) -> DataFrame:
    """query, item, score, rank by the sum of 1 / (k0 + rank)."""
    fused = ranked.groupBy(query, item).agg(F.round(F.sum(1.0 / (F.lit(k0) + F.col("rank"))), 9).alias("score"))
    return rk.ranked(fused, [query], "score", item)


def weighted(ranked: DataFrame, query: str, item: str, weights: dict[str, float], renormalise: bool = True) -> DataFrame:
    """query, item, score, rank by the weighted sum of per-channel min-max scores. With ``renormalise`` the weights of a query's available
    channels are scaled to sum to 1; available channels that weigh nothing together have no rows."""
    use = ranked.where(F.col("channel").isin(list(weights))).withColumn("_w", weight_of(weights))
    bounds = use.groupBy(query, "channel").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.max("_w").alias("_w"))
    # one row per query and channel; the sum of weights needs no pass over the candidates
    total = bounds.groupBy(query).agg(F.sum("_w").alias("_t")) if renormalise else bounds.select(query).distinct().withColumn("_t", F.lit(1.0))
    facts = bounds.join(total.where("_t > 0"), query)
    norm = rk.minmax(F.col("score"), F.col("_lo"), F.col("_hi"))
    part = use.drop("_w").join(facts, [query, "channel"]).withColumn("_p", norm * F.col("_w") / F.col("_t"))
    fused = part.groupBy(query, item).agg(F.round(F.sum("_p"), 9).alias("score"))
    return rk.ranked(fused, [query], "score", item)


def fallback_reason(content: Column, cf: Column, popularity: Column) -> Column:
    """Why a hybrid list is degraded: null with all channels, else what is missing."""
    return (
        F.when(content & cf, F.lit(None).cast("string"))
        .when(content, F.lit("cf_user_unavailable"))
        .when(cf, F.lit("no_usable_content_history"))
        .when(popularity, F.lit("popularity_only"))
        .otherwise(F.lit("no_channel"))
    )
