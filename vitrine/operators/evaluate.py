"""Ranking metrics over long tables of ranked items and relevant items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 20)


def ideal(n: Column, k: int) -> Column:
    """The ideal discounted gain of n relevant items within k places."""
    places = F.sequence(F.lit(1), F.lit(k))
    return F.aggregate(F.filter(places, lambda i: i <= n), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))


def metrics(ranked: DataFrame, relevant: DataFrame, keys: Sequence[str], item: str, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """keys, mrr, and recall, precision and ndcg at each cutoff, one row per key that has relevant items. ``ranked``: keys, item, rank with
    each item once. Precision divides by the cutoff even for short lists; a key without hits has zeros."""
    n = relevant.select(*keys, item).distinct()
    hits = n.join(ranked.select(*keys, item, "rank"), [*keys, item], "left")
    rank = F.col("rank")
    aggs = [F.count(F.lit(1)).alias("_n"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr")]
    for k in cutoffs:
        aggs += [F.count(F.when(rank <= k, 1)).alias(f"_h{k}"), F.coalesce(F.sum(F.when(rank <= k, 1.0 / F.log2(rank + 1.0))), F.lit(0.0)).alias(f"_g{k}")]
    g = hits.groupBy(*keys).agg(*aggs)
    out = [*keys, "mrr"]
    cols = [F.col(c) for c in out]
    for k in cutoffs:
        cols += [(F.col(f"_h{k}") / F.col("_n")).alias(f"recall_{k}"), (F.col(f"_h{k}") / F.lit(float(k))).alias(f"precision_{k}"), F.coalesce(F.col(f"_g{k}") / F.nullif(ideal(F.col("_n"), k), F.lit(0.0)), F.lit(0.0)).alias(f"ndcg_{k}")]
    return g.select(*cols)


def from_rank(rank: Column, catalogue: Column | None = None, cutoffs: Sequence[int] = CUTOFFS) -> list[Column]:
    """Metric columns of one hidden item by its rank; null, below 1 or beyond the catalogue is a miss."""
    ok = rank.isNotNull() & (rank >= 1)
    if catalogue is not None:
        ok = ok & (rank <= catalogue)
    cols = [F.when(ok, 1.0 / rank).otherwise(0.0).alias("mrr")]
    for k in cutoffs:
        hit = ok & (rank <= k)
        cols += [F.when(hit, 1.0).otherwise(0.0).alias(f"recall_{k}"), F.when(hit, 1.0 / F.log2(rank + 1.0)).otherwise(0.0).alias(f"ndcg_{k}")]
    return cols


def averages(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Macro averages (rounded to 6 digits) and n, over all rows or per segment."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])
