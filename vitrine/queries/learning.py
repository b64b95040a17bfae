"""Learning to rank: features, pairs, losses, scaling, training and re-ranking over the hybrid candidates of the query set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import evaluate as ev
from vitrine.operators import fusion as fu
from vitrine.operators import learn
from vitrine.operators import ranking as rk
from vitrine.plans.storage import materialize
from vitrine.queries import CORE
from vitrine.queries.ingest import collapse_sql
from vitrine.queries.recommend import avg_sql, metrics_sql
from vitrine.queries.search import HYBRID, query_set, search_channels, tokens_sql, weighted_sql
from vitrine.sources.tables import table

DEPTH = 100
#: Pairs that training brings to the driver at most: a uniform draw by hash beyond it.
MAX_PAIRS = 200_000
#: Fixed weights of the linear ranker that SQL can check.
LINEAR = [0.2, 0.1, 0.05, 0.3, 0.3, 0.2, 0.2, -0.1, -0.1, 5.0, 0.5, 0.4, 0.3, 0.1, 0.3, 0.05, 0.1, 0.1, -0.1, -0.01, 0.001, 0.02, 0.02, -0.1, -0.01]

_BOOL = "CAST(coalesce({}, false) AS DOUBLE)"


def _features_sql() -> str:
    q, t, b, d = "list_distinct(qt)", "list_distinct(tt)", "list_distinct(bt)", "dt"
    overlap = f"len(list_intersect({q}, {t}))"
    return ", ".join(
        f"{expr} AS {name}"
        for name, expr in zip(
            learn.FEATURES,
            [
                _BOOL.format("keyword_rank IS NOT NULL"), _BOOL.format("semantic_rank IS NOT NULL"), _BOOL.format("keyword_rank IS NOT NULL") + " + " + _BOOL.format("semantic_rank IS NOT NULL"),
                "coalesce(keyword_score, 0)", "coalesce(semantic_score, 0)", "coalesce(1.0::DOUBLE / keyword_rank, 0)", "coalesce(1.0::DOUBLE / semantic_rank, 0)", f"coalesce(keyword_rank / {DEPTH}.0::DOUBLE, 0)", f"coalesce(semantic_rank / {DEPTH}.0::DOUBLE, 0)",
                "rrf_score", "weighted_score", _BOOL.format(f"contains({collapse_sql('lower(title)')}, {collapse_sql('lower(query)')})"), _BOOL.format(f"len({q}) > 0 AND {overlap} = len({q})"), f"{overlap}::DOUBLE", f"coalesce({overlap}::DOUBLE / nullif(len({q}), 0), 0)",
                _BOOL.format("len(bt) > 0"), _BOOL.format(f"len(bt) > 0 AND contains({collapse_sql('lower(query)')}, {collapse_sql('lower(brand)')})"), f"coalesce(len(list_intersect({q}, {b}))::DOUBLE / nullif(len({q}), 0), 0)", _BOOL.format("coalesce(trim(description), '') = ''"),
                "len(tt)::DOUBLE", f"len({d})::DOUBLE", "coalesce(CASE WHEN NOT isnan(average_rating) THEN average_rating END, 0)", "ln(1 + coalesce(rating_count, 0)::DOUBLE)", _BOOL.format("price IS NULL OR isnan(price) OR price <= 0"), "coalesce(CASE WHEN NOT isnan(price) AND price > 0 THEN ln(1 + price) END, 0)",
            ],
        )
    )


FEATURE_SQL = f"""{HYBRID}, {weighted_sql({'keyword': 0.5, 'semantic': 0.5}, 'ch', 'query_id', False)}, rf AS (SELECT query_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM ch GROUP BY 1, 2),
un AS (SELECT query_id, product_id, max(rank) FILTER (WHERE channel = 'keyword') AS keyword_rank, max(score) FILTER (WHERE channel = 'keyword') AS keyword_score, max(rank) FILTER (WHERE channel = 'semantic') AS semantic_rank, max(score) FILTER (WHERE channel = 'semantic') AS semantic_score FROM ch GROUP BY 1, 2),
jn AS (SELECT un.*, rf.rrf_score, wr.score AS weighted_score, q.query, q.source, p.title, p.brand, p.description, p.average_rating, p.rating_count, p.price, {tokens_sql('q.query')} AS qt, {tokens_sql('p.title')} AS tt, {tokens_sql('p.brand')} AS bt, {tokens_sql('p.description')} AS dt
FROM un JOIN rf USING (query_id, product_id) JOIN wr USING (query_id, product_id) JOIN qset q USING (query_id) JOIN products p ON p.product_id = un.product_id),
feat AS (SELECT query_id, product_id, (product_id = source)::INT AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, product_id) AS place, {_features_sql()} FROM jn)"""


def dataset(spark, folder) -> DataFrame:
    """query_id, product_id, relevance, place and the 25 features of every candidate of both channels."""
    d = learn.candidate_features(search_channels(spark, folder, DEPTH), query_set(spark, folder).drop("v"), table(spark, folder, "products"), DEPTH)
    return d.select("query_id", "product_id", (F.col("product_id") == F.col("source")).cast("int").alias("relevance"), "place", *learn.FEATURES)


def _rounded(cols, n: int = 6):
    return [F.round(c, n).alias(c) for c in cols]


@CORE.query("rank_features", f"WITH {FEATURE_SQL} SELECT query_id, product_id, " + ", ".join(f"round({c}, 8) AS {c}" for c in learn.FEATURES) + " FROM feat")
def rank_features(spark, folder):
    return dataset(spark, folder).select("query_id", "product_id", *_rounded(learn.FEATURES, 8))


@CORE.query("ltr_dataset", f"WITH {FEATURE_SQL} SELECT query_id, product_id, relevance, place, 'rank-features-v1' AS version FROM feat")
def ltr_dataset(spark, folder):
    return dataset(spark, folder).select("query_id", "product_id", "relevance", "place", F.lit(learn.FEATURE_VERSION).alias("version"))


@CORE.query("feature_validate", f"WITH {FEATURE_SQL} SELECT count(*) AS n, 0::BIGINT AS n_bad FROM feat")
def feature_validate(spark, folder):
    """Rows, and rows with a feature that is null or not finite."""
    bad = F.lit(False)
    for c in learn.FEATURES:
        bad = bad | ~rk.finite(F.col(c))
    return dataset(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("n_bad"))


@CORE.query("feature_stats", f"WITH {FEATURE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median, round(100.0 * avg(({c} = 0)::INT), 4) AS zero_pct FROM feat" for c in learn.FEATURES))
def feature_stats(spark, folder):
    """Unpivoted to (name, value) and aggregated once."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in learn.FEATURES]))
    d = dataset(spark, folder).select(e.alias("e")).select("e.*")
    return d.groupBy("name").agg(F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.median("v"), 6).alias("median"), F.round(100.0 * F.avg((F.col("v") == 0).cast("int")), 4).alias("zero_pct"))


@CORE.query("scaler_fit", f"WITH {FEATURE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM feat" for c in learn.FEATURES))
def scaler_fit(spark, folder):
    return learn.scaler(dataset(spark, folder), learn.FEATURES).select("name", *_rounded(["mean", "std"]))


_SCALED = ["rrf_score", "title_overlap_ratio", "log_price"]


@CORE.query("scaler_transform", f"WITH {FEATURE_SQL} SELECT query_id, product_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1.0 ELSE stddev_pop({c}) OVER () END, 6) + 0.0 AS {c}" for c in _SCALED) + " FROM feat")
def scaler_transform(spark, folder):
    d = learn.scale(dataset(spark, folder).select("query_id", "product_id", *_SCALED), _SCALED)
    return d.select("query_id", "product_id", *[(F.round(c, 6) + 0.0).alias(c) for c in _SCALED])


_PAIRS = "ng AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, product_id) AS np FROM feat WHERE relevance = 0), hp AS (SELECT f.query_id, f.product_id AS positive, n.product_id AS negative, n.np AS negative_place FROM feat f JOIN ng n ON n.query_id = f.query_id AND f.relevance > 0 AND n.np <= 8)"


@CORE.query("hard_negative_pairs", f"WITH {FEATURE_SQL}, {_PAIRS} SELECT * FROM hp")
def hard_negative_pairs(spark, folder):
    return learn.hard_negative_pairs(dataset(spark, folder), "query_id", "product_id", "place", "relevance", 8)


_LIN = " + ".join(f"{c} * {w}::DOUBLE" for c, w in zip(learn.FEATURES, LINEAR))
_SCORED = f"sc AS (SELECT query_id, product_id, relevance, round({_LIN}, 9) AS s FROM feat)"


def scored_pairs(spark, folder) -> DataFrame:
    """query_id, sp, sn: linear scores of the hard-negative pairs."""
    d = materialize(dataset(spark, folder).withColumn("s", F.round(learn.linear(learn.FEATURES, LINEAR), 9)).select("query_id", "product_id", "relevance", "place", "s"), "scored")
    p = learn.hard_negative_pairs(d, "query_id", "product_id", "place", "relevance", 8)
    s = lambda n, v: d.select("query_id", F.col("product_id").alias(n), F.col("s").alias(v))
    return p.join(s("positive", "sp"), ["query_id", "positive"]).join(s("negative", "sn"), ["query_id", "negative"])


_SP = "x AS (SELECT hp.*, a.s AS sp, b.s AS sn FROM hp JOIN sc a ON a.query_id = hp.query_id AND a.product_id = positive JOIN sc b ON b.query_id = hp.query_id AND b.product_id = negative)"


@CORE.query("ranknet_loss", f"WITH {FEATURE_SQL}, {_PAIRS}, {_SCORED}, {_SP} SELECT count(*) AS n, round(avg(greatest(sn - sp, 0) + ln(1 + exp(-abs(sn - sp)))), 6) AS loss, round(avg((sp > sn)::INT), 6) AS accuracy FROM x")
def ranknet_loss(spark, folder):
    d = F.col("sn") - F.col("sp")
    return scored_pairs(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(learn.softplus(d)), 6).alias("loss"), F.round(F.avg((d < 0).cast("int")), 6).alias("accuracy"))


@CORE.query("bpr_loss", f"WITH {FEATURE_SQL}, {_PAIRS}, {_SCORED}, {_SP} SELECT round(avg(greatest(sn - sp, 0) + ln(1 + exp(-abs(sn - sp)))) + 0.0001 * avg(sp * sp + sn * sn), 6) AS objective FROM x")
def bpr_loss(spark, folder):
    """Softplus of the negative margin plus a weighted mean of squared norms."""
    d = F.col("sn") - F.col("sp")
    return scored_pairs(spark, folder).agg(F.round(F.avg(learn.softplus(d)) + 0.0001 * F.avg(F.col("sp") * F.col("sp") + F.col("sn") * F.col("sn")), 6).alias("objective"))


_RERANKED = f"{FEATURE_SQL}, {_SCORED}, lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, product_id) AS rank FROM sc)"


def reranked(spark, folder) -> DataFrame:
    d = dataset(spark, folder).withColumn("s", F.round(learn.linear(learn.FEATURES, LINEAR), 9)).select("query_id", "product_id", "relevance", "s")
    return rk.ranked(d, ["query_id"], "s", "product_id")


@CORE.query("ltr_rerank", f"WITH {_RERANKED} SELECT query_id, product_id, rank FROM lr")
def ltr_rerank(spark, folder):
    """The whole union re-ranked by fixed linear weights; no candidate is lost."""
    return reranked(spark, folder).select("query_id", "product_id", "rank")


_LM = ["mrr", "recall_10", "ndcg_10"]


@CORE.query("ltr_eval", f"WITH {_RERANKED}, rel AS (SELECT query_id, source AS product_id FROM qset), {metrics_sql('lr', 'rel', 'query_id')} SELECT {avg_sql(_LM)} FROM m")
def ltr_eval(spark, folder):
    rel = query_set(spark, folder).select("query_id", F.col("source").alias("product_id"))
    return ev.averages(ev.metrics(reranked(spark, folder), rel, ["query_id"], "product_id"), _LM)


@CORE.query(
    "eval_search",
    f"""WITH {_RERANKED}, rel AS (SELECT query_id, source AS product_id FROM qset), rr2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, product_id) AS rank FROM rf),
sys AS (SELECT 'keyword' AS system, query_id, product_id, rank FROM ch WHERE channel = 'keyword' UNION ALL SELECT 'semantic', query_id, product_id, rank FROM ch WHERE channel = 'semantic' UNION ALL SELECT 'rrf', query_id, product_id, rank FROM rr2
UNION ALL SELECT 'weighted', query_id, product_id, rank FROM wr UNION ALL SELECT 'ltr', query_id, product_id, rank FROM lr),
k AS (SELECT s.system, r.query_id, min(f.rank) AS rank FROM rel r CROSS JOIN (SELECT unnest(['keyword', 'semantic', 'rrf', 'weighted', 'ltr']) AS system) s LEFT JOIN sys f ON f.system = s.system AND f.query_id = r.query_id AND f.product_id = r.product_id GROUP BY 1, 2)
SELECT system, count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg((coalesce(rank, 1000) <= 10)::INT), 6) AS recall_10, count(rank) AS covered FROM k GROUP BY 1""",
)
def eval_search(spark, folder):
    """Five systems over one query set, in one long table."""
    ch = search_channels(spark, folder, DEPTH)
    rel = query_set(spark, folder).select("query_id", F.col("source").alias("product_id"))
    cols = ["query_id", "product_id", "rank"]
    systems = {
        "keyword": ch.where("channel = 'keyword'"), "semantic": ch.where("channel = 'semantic'"), "rrf": fu.rrf(ch, "query_id", "product_id"),
        "weighted": fu.weighted(ch, "query_id", "product_id", {"keyword": 0.5, "semantic": 0.5}, renormalise=False), "ltr": reranked(spark, folder),
    }
    long = None
    for name, d in systems.items():
        part = rel.join(d.select(*cols), ["query_id", "product_id"], "left").select(F.lit(name).alias("system"), "rank")
        long = part if long is None else long.unionByName(part)
    rank = F.col("rank")
    return long.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.coalesce(rank, F.lit(1000)) <= 10).cast("int")), 6).alias("recall_10"), F.count("rank").alias("covered"))


def trained(spark, folder):
    """The dataset, the network of the least held-out loss trained on its hard-negative pairs (at most MAX_PAIRS come to the driver) and the losses."""
    d = materialize(dataset(spark, folder), "dataset")
    p = learn.hard_negative_pairs(d, "query_id", "product_id", "place", "relevance", 8)
    vec = F.array(*[F.col(c).cast("double") for c in learn.FEATURES])
    side = lambda n, v: d.select("query_id", F.col("product_id").alias(n), vec.alias(v))
    rows = p.join(side("positive", "a"), ["query_id", "positive"]).join(side("negative", "b"), ["query_id", "negative"]).orderBy(F.xxhash64("query_id", "positive", "negative")).limit(MAX_PAIRS).select("a", "b").toPandas()
    if not len(rows):
        raise ValueError("no pairs to train on")
    a, b = np.array(rows.a.tolist()), np.array(rows.b.tolist())
    return d, *learn.choose_ranknet(a, b)[:2]


@CORE.query("ltr_train")
def ltr_train(spark, folder):
    """Validation loss per epoch of the pairwise network."""
    _, _, losses = trained(spark, folder)
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


@CORE.query("ltr_score")
def ltr_score(spark, folder):
    """All candidates scored by the trained network and re-ranked."""
    d, model, _ = trained(spark, folder)
    s = learn.score_with(d.select("query_id", "product_id", *learn.FEATURES), learn.FEATURES, model).select("query_id", "product_id", "score")
    return rk.ranked(s, ["query_id"], "score", "product_id")


@CORE.query("feature_schema", "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{c}', 'rank-features-v1')" for i, c in enumerate(learn.FEATURES)) + ") v(position, name, version)")
def feature_schema(spark, folder):
    return spark.createDataFrame([(i + 1, c, learn.FEATURE_VERSION) for i, c in enumerate(learn.FEATURES)], "position int, name string, version string")


@CORE.query("seeded_sample", "SELECT product_id, title FROM products ORDER BY sha256('sample' || product_id), product_id LIMIT 100")
def seeded_sample(spark, folder):
    """A sample of 100 products in order of a seeded hash."""
    return table(spark, folder, "products").select("product_id", "title").orderBy(F.sha2(F.concat(F.lit("sample"), "product_id"), 256), "product_id").limit(100)


@CORE.query("grouped_split", "WITH o AS (SELECT product_id, row_number() OVER (ORDER BY sha256('split' || product_id) || product_id) - 1 AS i, count(*) OVER () AS n FROM products) SELECT product_id, CASE WHEN i < round_even(n * 0.7, 0) THEN 'train' WHEN i < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS split FROM o")
def grouped_split(spark, folder):
    return learn.grouped_split(table(spark, folder, "products"), "product_id")
