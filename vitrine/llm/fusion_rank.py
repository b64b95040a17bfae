"""One ranking from scores on unlike scales, by Borda count.

Per request and score, candidates get competition ranks with averaged ties (best first). A missing score gets the mid-rank of the request.
A candidate's points are the weighted sum of (candidates - rank); candidates are ordered by points, then by identifier.

A request with more than 1/MAX_HOT of all rows is ranked without gathering it: by counts of distinct scores, added up over buckets of the
score that are cut at its quantiles. Both ways give the same ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrine.plans.storage import materialize

MAX_HOT = 200
CUTS = 256
SALTS = 16
#: A request of so many rows may be hot; ties of more rows are ordered by ranges.
LEAST_HOT, BIG_TIE = 1_000, 10_000


def candidates(df: DataFrame, request: str, item: str, scores: dict[str, tuple[str, str | None]]) -> DataFrame:
    """request, item and one column per score: each candidate of a request once, with its best finite score. A score that is null, NaN,
    infinite or marked as not present is missing. Rows without request or item are left out."""
    cols = [F.col(request).alias("request"), F.col(item).alias("item")]
    for name, (score, present) in scores.items():
        s = F.col(score).cast("double")
        ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
        ok = ok & F.coalesce(F.col(present), F.lit(False)) if present else ok
        cols.append(F.when(ok, s + F.lit(0.0)).alias(name))
    rows = df.select(*cols).where(F.col("request").isNotNull() & F.col("item").isNotNull())
    return rows.groupBy("request", "item").agg(*[F.max(n).alias(n) for n in scores])


def _points(n: Column, rank: Column, weight: float | Column) -> Column:
    """Points of one score: candidates less rank; a missing score has the mid-rank (n + 1) / 2."""
    return (n - F.coalesce(rank, (n + 1) * F.lit(0.5))) * (F.lit(float(weight)) if isinstance(weight, float) else weight)


def _light(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    everyone = W.partitionBy("request")
    n = F.count(F.lit(1)).over(everyone)
    parts = []
    for name, weight in weights.items():
        same = W.partitionBy("request", name)
        rank = F.when(F.col(name).isNotNull(), F.rank().over(everyone.orderBy(F.col(name).desc_nulls_last())) + (F.count(F.lit(1)).over(same) - 1) / 2)
        parts.append(_points(n, rank, float(weight)))
    pointed = rows.withColumn("points", F.round(reduce(lambda a, b: a + b, parts), 9))
    place = F.row_number().over(everyone.orderBy(F.col("points").desc(), "item"))
    return pointed.select("request", "item", "points", place.cast("bigint").alias("place"))


def _before(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v, w, before: the weight of all smaller v of the same keys. ``values`` has each (keys, v) once, and few distinct keys."""
    cuts = values.groupBy(*keys).agg(F.percentile_approx("v", [(i + 1) / CUTS for i in range(CUTS - 1)], 10_000).alias("cuts"))
    cut = values.join(F.broadcast(cuts), keys).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = cut.groupBy(*keys, "bucket").agg(F.sum("w").alias("s"))
    earlier = sums.withColumn("offset", F.coalesce(F.sum("s").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = F.coalesce(F.sum("w").over(W.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("inside", inside).join(F.broadcast(earlier), [*keys, "bucket"]).select(*keys, "v", "w", (F.col("inside") + F.col("offset")).alias("before"))


def _attach(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join whose right side is repeated for each salt, because one key may be most of the rows."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"]).drop("salt")


def _heavy(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    sizes = rows.groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array(*[F.struct(F.lit(name).alias("score"), (-F.col(name)).alias("v"), F.lit(float(w)).alias("weight")) for name, w in weights.items()])
    long = rows.select("request", "item", F.explode(entries).alias("e")).select("request", "item", "e.*")
    have = long.where(F.col("v").isNotNull())
    values = have.groupBy("request", "score", "v").agg(F.count(F.lit(1)).alias("w"))
    ranks = _before(values, ["request", "score"]).withColumn("rank", F.col("before") + (F.col("w") + 1) / 2)
    ranked = _attach(have, ranks.select("request", "score", "v", "rank"), ["request", "score", "v"])
    each = ranked.unionByName(long.where(F.col("v").isNull()).withColumn("rank", F.lit(None).cast("double")))
    each = each.join(F.broadcast(sizes), "request")
    p = _points(F.col("n"), F.col("rank"), F.col("weight"))
    # added in the order of the scores' names as given, so that sums are the same on both ways
    per = each.groupBy("request", "item").agg(*[F.max(F.when(F.col("score") == name, p)).alias(f"p_{i}") for i, name in enumerate(weights)])
    pointed = materialize(per.select("request", "item", F.round(reduce(lambda a, b: a + b, [F.col(f"p_{i}") for i in range(len(weights))]), 9).alias("points")), "points")
    tied = pointed.groupBy("request", (-F.col("points")).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    better = _before(tied, ["request"]).select("request", "v", F.col("before").alias("better"), "w")
    at = _attach(pointed.withColumn("v", -F.col("points")), better, ["request", "v"])
    # a tie of many is cut into ranges of the identifier, and the ranges before a row are added up
    many = F.col("w") > BIG_TIE
    few = at.where(~many).withColumn("place", F.col("better") + F.row_number().over(W.partitionBy("request", "points").orderBy("item")))
    big = materialize(at.where(many).repartitionByRange("request", "points", "item").withColumn("range", F.spark_partition_id()), "ties")
    sizes = big.groupBy("request", "points", "range").agg(F.count(F.lit(1)).alias("s"))
    earlier = F.coalesce(F.sum("s").over(W.partitionBy("request", "points").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    big = big.join(sizes.select("request", "points", "range", earlier.alias("earlier")), ["request", "points", "range"])
    big = big.withColumn("place", F.col("better") + F.col("earlier") + F.row_number().over(W.partitionBy("request", "points", "range").orderBy("item")))
    out = ["request", "item", "points", F.col("place").cast("bigint").alias("place")]
    return few.select(*out).unionByName(big.select(*out))


def borda(rows: DataFrame, weights: dict[str, float], max_hot: int = MAX_HOT) -> DataFrame:
    """request, item, points, place (1 is best) of every candidate of candidates()."""
    sizes = rows.groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(sizes.agg(F.sum("n").alias("total")))
    # at least LEAST_HOT rows, or small tables would have nothing but hot requests; at most max_hot requests by definition
    hot = F.broadcast(sizes.crossJoin(total).where((F.col("n") * F.lit(max_hot) > F.col("total")) & (F.col("n") > LEAST_HOT)).select("request"))
    return _light(rows.join(hot, "request", "left_anti"), weights).unionByName(_heavy(rows.join(hot, "request", "left_semi"), weights))
