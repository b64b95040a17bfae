"""Bounded personal re-ranking of the requests' fused candidates, and its tuning and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import evaluate as ev
from vitrine.operators import personal as pe
from vitrine.operators import ranking as rk
from vitrine.operators import vectors as ve
from vitrine.plans.storage import materialize
from vitrine.queries import CORE
from vitrine.queries.recommend import FUSED, RECS, RELEVANT, all_profiles, avg_sql, fused, metrics_sql, relevant
from vitrine.queries.relational import events, products
from vitrine.queries.search import unit_vectors
from vitrine.sources.tables import table

#: The frozen serving policy, and the default before tuning.
POLICY, GAMMA = {"content": 0.0, "cf": 1.0}, 0.30
DEFAULT, DEFAULT_GAMMA = {"content": 0.7, "cf": 0.3}, 0.10

BASE = f"""{FUSED}, {RECS}, own AS (SELECT DISTINCT request_id, user_id FROM hybrid_candidates),
aff AS (SELECT f.request_id, f.product_id, f.score AS baseline_score, f.rank AS baseline_rank, round(list_dot_product(p.v, u.v), 9) AS content, round(list_dot_product(p.v[17:32], u.v[1:16]), 9) AS cf
FROM fused f JOIN own USING (request_id) LEFT JOIN profile p USING (user_id) LEFT JOIN unit u ON u.product_id = f.product_id)"""


def affinities(spark, folder) -> DataFrame:
    """request_id, product_id, baseline_score, baseline_rank, content, cf: affinities are null without profile or vector."""
    own = table(spark, folder, "hybrid_candidates").select("request_id", "user_id").distinct()
    prof = all_profiles(spark, folder).select("user_id", F.col("v").alias("_u"))
    v = unit_vectors(spark, folder).select("product_id", F.col("v").alias("_v"))
    d = fused(spark, folder).join(own, "request_id").join(prof, "user_id", "left").join(v, "product_id", "left")
    cut = lambda c, i: F.slice(c, i, 16)
    return d.select("request_id", "product_id", F.col("score").alias("baseline_score"), F.col("rank").alias("baseline_rank"), F.round(ve.dot(F.col("_u"), F.col("_v")), 9).alias("content"), F.round(ve.dot(cut("_u", 17), cut("_v", 1)), 9).alias("cf"))



def rerank_sql(weights: dict[str, float], gamma: float, name: str = "pr", source: str = "aff") -> str:
    w = {s: f"CASE WHEN {s}_lo IS NULL THEN 0 WHEN wt > 0 THEN {v}::DOUBLE / wt ELSE 1.0::DOUBLE / nullif(na, 0) END" for s, v in weights.items()}
    norm = {s: f"CASE WHEN {s} IS NULL THEN 0 WHEN {s}_hi = {s}_lo THEN 1.0 ELSE ({s} - {s}_lo) / ({s}_hi - {s}_lo) END" for s in weights}
    pref = " + ".join(f"({w[s]}) * ({norm[s]})" for s in weights)
    return f"""{name}_b AS (SELECT request_id, min(baseline_score) AS lo, max(baseline_score) AS hi, count(*) AS n, {', '.join(f'min({s}) AS {s}_lo, max({s}) AS {s}_hi' for s in weights)} FROM {source} GROUP BY 1),
{name}_w AS (SELECT *, {' + '.join(f'CASE WHEN {s}_lo IS NULL THEN 0 ELSE {v}::DOUBLE END' for s, v in weights.items())} AS wt, {' + '.join(f'({s}_lo IS NOT NULL)::INT' for s in weights)} AS na FROM {name}_b),
{name}_f AS (SELECT a.*, na, CASE WHEN lo = hi THEN (n - baseline_rank + 1)::DOUBLE / n ELSE (baseline_score - lo) / (hi - lo) END AS q, coalesce({pref}, 0) AS preference FROM {source} a JOIN {name}_w USING (request_id)),
{name}_g AS (SELECT *, round(q * (1 + {gamma}::DOUBLE * least(greatest(preference, 0), 1)), 9) AS final FROM {name}_f),
{name} AS (SELECT *, CASE WHEN na = 0 THEN baseline_rank ELSE row_number() OVER (PARTITION BY request_id ORDER BY final DESC, baseline_rank, product_id) END AS rank FROM {name}_g)"""


@CORE.query("content_affinity", f"WITH {BASE} SELECT request_id, product_id, content FROM aff")
def content_affinity(spark, folder):
    return affinities(spark, folder).select("request_id", "product_id", "content")


@CORE.query("cf_affinity", f"WITH {BASE} SELECT request_id, product_id, cf FROM aff")
def cf_affinity(spark, folder):
    return affinities(spark, folder).select("request_id", "product_id", "cf")


@CORE.query("brand_affinity", "WITH b AS (SELECT i.user_id, p.brand, count(*) AS n FROM interactions i JOIN products p USING (product_id) WHERE trim(p.brand) <> '' GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS t FROM b GROUP BY 1) SELECT b.user_id, brand, round(n::DOUBLE / t, 6) AS share FROM b JOIN t USING (user_id)")
def brand_affinity(spark, folder):
    """Share of a brand among a user's events with a brand. Events are added up per product before the join."""
    n = events(spark, folder).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    b = n.join(products(spark, folder).where(F.trim("brand") != "").select("product_id", "brand"), "product_id").groupBy("user_id", "brand").agg(F.sum("n").alias("n"))
    t = b.groupBy("user_id").agg(F.sum("n").alias("t"))
    return b.join(t, "user_id").select("user_id", "brand", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@CORE.query("minmax_channel", f"WITH {BASE}, b AS (SELECT request_id, min(content) AS lo, max(content) AS hi FROM aff GROUP BY 1) SELECT request_id, product_id, round(CASE WHEN content IS NULL THEN 0 WHEN hi = lo THEN 1.0 ELSE (content - lo) / (hi - lo) END, 6) AS norm, lo IS NOT NULL AS available FROM aff JOIN b USING (request_id)")
def minmax_channel(spark, folder):
    d = pe.channel_norm(affinities(spark, folder), "request_id", "content")
    return d.select("request_id", "product_id", F.round("content_norm", 6).alias("norm"), F.col("content_available").alias("available"))


@CORE.query("query_relevance", f"WITH {BASE}, {rerank_sql(DEFAULT, DEFAULT_GAMMA)} SELECT request_id, product_id, round(q, 6) AS q FROM pr")
def query_relevance(spark, folder):
    return pe.query_relevance(affinities(spark, folder), "request_id").select("request_id", "product_id", F.round("q", 6).alias("q"))


_CASES = [(True, True), (True, False), (False, True), (False, False)]


@CORE.query("signal_weights", "SELECT * FROM (VALUES (true, true, 0.0::DOUBLE, 1.0::DOUBLE), (true, false, 1.0, 0.0), (false, true, 0.0, 1.0), (false, false, 0.0, 0.0)) v(has_content, has_cf, content, cf)")
def signal_weights(spark, folder):
    """The frozen policy over all combinations of available signals: a lone signal of weight 0 gets everything."""
    d = spark.createDataFrame(_CASES, "has_content boolean, has_cf boolean")
    w = pe.signal_weights(POLICY, {"content": F.col("has_content"), "cf": F.col("has_cf")})
    return d.select("has_content", "has_cf", w["content"].alias("content"), w["cf"].alias("cf"))


@CORE.query("gated_score", f"WITH {BASE}, {rerank_sql(POLICY, GAMMA)} SELECT request_id, product_id, round(preference, 6) AS preference, final FROM pr")
def gated_score(spark, folder):
    d = pe.rerank(affinities(spark, folder), "request_id", "product_id", POLICY, GAMMA)
    return d.select("request_id", "product_id", F.round("preference", 6).alias("preference"), "final")


@CORE.query("personalized_rerank", f"WITH {BASE}, {rerank_sql(POLICY, GAMMA)} SELECT request_id, product_id, baseline_rank, rank FROM pr")
def personalized_rerank(spark, folder):
    return pe.rerank(affinities(spark, folder), "request_id", "product_id", POLICY, GAMMA).select("request_id", "product_id", "baseline_rank", "rank")


@CORE.query("personalized_search", f"WITH {BASE}, {rerank_sql(POLICY, GAMMA)} SELECT request_id, rank, p.product_id, p.title FROM pr JOIN products p USING (product_id) WHERE rank <= 10")
def personalized_search(spark, folder):
    """The whole pool re-ranked, then cut, then titles attached."""
    top = pe.rerank(affinities(spark, folder), "request_id", "product_id", POLICY, GAMMA).where("rank <= 10")
    return top.join(products(spark, folder).select("product_id", "title"), "product_id").select("request_id", "rank", "product_id", "title")


_M = ["mrr", "recall_10", "ndcg_10"]


@CORE.query("eval_personalized", f"WITH {BASE}, {rerank_sql(POLICY, GAMMA)}, {RELEVANT}, a AS (SELECT 'baseline' AS system, * FROM (WITH {metrics_sql('fused', 'rel', 'request_id')} SELECT {avg_sql(_M)} FROM m)), b AS (SELECT 'personalized' AS system, * FROM (WITH {metrics_sql('pr', 'rel', 'request_id')} SELECT {avg_sql(_M)} FROM m)) SELECT * FROM a UNION ALL SELECT * FROM b")
def eval_personalized(spark, folder):
    rel = materialize(relevant(spark, folder), "relevant")
    moved = pe.rerank(affinities(spark, folder), "request_id", "product_id", POLICY, GAMMA)
    one = lambda name, d: ev.averages(ev.metrics(d, rel, ["request_id"], "product_id"), _M).select(F.lit(name).alias("system"), "n", *_M)
    return one("baseline", fused(spark, folder)).unionByName(one("personalized", moved))


_SIGNALS, _GAMMAS = [(1.0, 0.0), (0.7, 0.3), (0.5, 0.5), (0.3, 0.7), (0.0, 1.0)], [0.05, 0.10, 0.20, 0.30]


def _tune_sql() -> str:
    parts = []
    for i, (w, g) in enumerate((w, g) for w in _SIGNALS for g in _GAMMAS):
        parts.append(f"SELECT {i} AS config, {w[0]}::DOUBLE AS content_weight, {g}::DOUBLE AS gamma, * FROM (WITH {rerank_sql(dict(zip(('content', 'cf'), w)), g)}, {metrics_sql('pr', 'rel', 'request_id')} SELECT {avg_sql(_M)} FROM m)")
    base = BASE.replace("aff AS (SELECT f.request_id", "aff AS MATERIALIZED (SELECT f.request_id")
    return f"WITH {base}, {RELEVANT}, g AS ({' UNION ALL '.join(parts)}) SELECT *, row_number() OVER (ORDER BY ndcg_10 DESC, recall_10 DESC, mrr DESC, gamma, content_weight DESC) = 1 AS winner FROM g"


@CORE.query("tune_personalization", _tune_sql())
def tune_personalization(spark, folder):
    """Twenty configurations on the same candidates; winner by NDCG@10, recall@10, MRR, smaller gamma, larger content weight."""
    a, rel = materialize(affinities(spark, folder), "affinities"), materialize(relevant(spark, folder), "relevant")
    configs = [(w, g) for w in _SIGNALS for g in _GAMMAS]
    one = lambda i, w, g: ev.averages(ev.metrics(pe.rerank(a, "request_id", "product_id", dict(zip(("content", "cf"), w)), g), rel, ["request_id"], "product_id"), _M).select(F.lit(i).alias("config"), F.lit(w[0]).alias("content_weight"), F.lit(g).alias("gamma"), "n", *_M)
    g = reduce(DataFrame.unionByName, [one(i, w, x) for i, (w, x) in enumerate(configs)])
    order = rk.W.orderBy(F.col("ndcg_10").desc(), F.col("recall_10").desc(), F.col("mrr").desc(), "gamma", F.col("content_weight").desc())  # twenty rows
    return g.withColumn("winner", F.row_number().over(order) == 1)
