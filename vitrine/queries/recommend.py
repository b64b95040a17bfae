"""Recommendations, splits and their evaluation.

Factors are fixed for the SQL-checked queries: an item's latent factor is the first quarter of its vector, a user's the second quarter of
their profile. Trained factors (implicit ALS) have queries of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import evaluate as ev
from vitrine.operators import fusion as fu
from vitrine.operators import history as hist
from vitrine.operators import kcore
from vitrine.operators import learn
from vitrine.operators import ranking as rk
from vitrine.operators import recommend as rec
from vitrine.operators import vectors as ve
from vitrine.plans.storage import materialize
from vitrine.queries import CORE
from vitrine.queries.relational import INNER, LONG, PAIRS, RANKED, SPLIT, _rounds_sql, channels, events, pairs, products, ranked_channels
from vitrine.queries.search import QUERY_SET, REC_WEIGHTS, unit_vectors, weighted_sql
from vitrine.sources.tables import table

UNIT = QUERY_SET[: QUERY_SET.index(",\nqset")]


def profile_sql(source: str, name: str = "profile") -> str:
    return f"""{name}_e AS (SELECT user_id, unnest(v) AS x, unnest(range(64)) AS j FROM {source} JOIN unit USING (product_id)), {name}_m AS (SELECT user_id, j, avg(x) AS x FROM {name}_e GROUP BY 1, 2),
{name}_n AS (SELECT user_id, list(x ORDER BY j) AS m, sqrt(sum(x * x)) AS n FROM {name}_m GROUP BY 1 HAVING sqrt(sum(x * x)) >= 1e-12), {name} AS (SELECT user_id, list_transform(m, lambda x: x / n) AS v FROM {name}_n)"""


def top_sql(name: str, vec: str, users: str, seen: str, k: int) -> str:
    """The k best unseen items of each user; ``vec``: an expression of p.v and u.v."""
    return f"""{name}_s AS (SELECT p.user_id, u.product_id, round({vec}, 9) AS score FROM {users} p, unit u WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = p.user_id AND s.product_id = u.product_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


DOT, CF_DOT = "list_dot_product(p.v, u.v)", "list_dot_product(p.v[17:32], u.v[1:16])"
RECS = f"{PAIRS}, {UNIT}, {profile_sql('pairs')}"
SPLITS = f"{SPLIT}, {UNIT}, train AS (SELECT user_id, product_id FROM split WHERE split = 'train'), hidden AS (SELECT user_id, product_id FROM split WHERE split = 'test'), {profile_sql('train')}"


def cf_items(vectors: DataFrame) -> DataFrame:
    return vectors.select("product_id", F.slice("v", 1, 16).alias("v"))


def cf_users(profiles: DataFrame) -> DataFrame:
    return profiles.select("user_id", F.slice("v", 17, 16).alias("v"))


def all_profiles(spark, folder) -> DataFrame:
    return rec.profiles(pairs(spark, folder), unit_vectors(spark, folder))


def content_list(spark, folder, k: int) -> DataFrame:
    return rec.vector_recs(all_profiles(spark, folder), unit_vectors(spark, folder).select("product_id", "v"), pairs(spark, folder), k)


def cf_list(spark, folder, k: int) -> DataFrame:
    return rec.vector_recs(cf_users(all_profiles(spark, folder)), cf_items(unit_vectors(spark, folder)), pairs(spark, folder), k)


def popular_list(spark, folder, k: int) -> DataFrame:
    counts = events(spark, folder).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return rec.popular_unseen(events(spark, folder).select("user_id"), pairs(spark, folder), rec.popular_places(counts), k)


@CORE.query("user_profile_vec", f"WITH {RECS} SELECT user_id, list_transform(v, lambda x: round(x, 6) + 0.0) AS v FROM profile")
def user_profile_vec(spark, folder):
    return all_profiles(spark, folder).select("user_id", F.transform("v", lambda x: F.round(x, 6) + F.lit(0.0)).alias("v"))


@CORE.query("content_recs", f"WITH {RECS}, {top_sql('c', DOT, 'profile', 'pairs', 10)} SELECT user_id, product_id, rank, score FROM c")
def content_recs(spark, folder):
    return content_list(spark, folder, 10)


@CORE.query("cf_recs", f"WITH {RECS}, {top_sql('c', CF_DOT, 'profile', 'pairs', 10)} SELECT user_id, product_id, rank, score FROM c")
def cf_recs(spark, folder):
    return cf_list(spark, folder, 10)


@CORE.query("score_all_pairs", f"WITH {RECS}, s AS (SELECT p.user_id, u.product_id, round({CF_DOT}, 9) AS score FROM profile p, unit u), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rank FROM s) SELECT user_id, product_id, score, rank FROM r WHERE rank <= 20")
def score_all_pairs(spark, folder):
    """Every user scored against every item, in blocks; the 20 best of each come out."""
    d = ve.exact_top_k(cf_users(all_profiles(spark, folder)), cf_items(unit_vectors(spark, folder)), 20, "user_id")
    return d


POP = "pop AS (SELECT *, row_number() OVER (ORDER BY n DESC, product_id) AS place FROM (SELECT product_id, count(*) AS n FROM interactions GROUP BY 1))"


def _pop_sql(k: int) -> str:
    return f"""pu AS (SELECT user_id, count(*) AS c FROM pairs GROUP BY 1), pc AS (SELECT u.user_id, p.* FROM pu u JOIN pop p ON p.place <= u.c + {k}),
pr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM pc c WHERE NOT EXISTS (SELECT 1 FROM pairs s WHERE s.user_id = c.user_id AND s.product_id = c.product_id))"""


@CORE.query("popularity_per_user", f"WITH {PAIRS}, {POP}, {_pop_sql(10)} SELECT user_id, product_id, n, rank FROM pr WHERE rank <= 10")
def popularity_per_user(spark, folder):
    return popular_list(spark, folder, 10)


@CORE.query(
    "hybrid_recs",
    f"""WITH {RECS}, {POP}, {top_sql('c', DOT, 'profile', 'pairs', 100)}, {top_sql('f', CF_DOT, 'profile', 'pairs', 100)}, {_pop_sql(100)},
ch AS (SELECT user_id, product_id, 'content' AS channel, score FROM c UNION ALL SELECT user_id, product_id, 'cf', score FROM f UNION ALL SELECT user_id, product_id, 'popularity', n::DOUBLE FROM pr WHERE rank <= 100),
{weighted_sql(REC_WEIGHTS, 'ch', 'user_id')} SELECT user_id, product_id, rank, score FROM wr WHERE rank <= 10""",
)
def hybrid_recs(spark, folder):
    """Three channels to depth 100, fused with weights renormalised over what a user has."""
    parts = [content_list(spark, folder, 100).withColumn("channel", F.lit("content")), cf_list(spark, folder, 100).withColumn("channel", F.lit("cf")), popular_list(spark, folder, 100).select("user_id", "product_id", F.col("n").cast("double").alias("score"), "rank").withColumn("channel", F.lit("popularity"))]
    ch = materialize(reduce(DataFrame.unionByName, parts), "lists")  # fusion reads it for bounds and again for scores
    return fu.weighted(ch, "user_id", "product_id", REC_WEIGHTS).where("rank <= 10").select("user_id", "product_id", "rank", "score")


def _indexed(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs with their indices u and i, users, items)."""
    from vitrine.operators.numbering import dense_ids

    p = pairs(spark, folder).where("product_id IS NOT NULL AND user_id IS NOT NULL")
    u, i = dense_ids(p.select("user_id").distinct(), "user_id", "u"), dense_ids(p.select("product_id").distinct(), "product_id", "i")
    return materialize(p.join(u, "user_id").join(i, "product_id"), "indexed"), u, i


@CORE.query("cf_train_als")
def cf_train_als(spark, folder):
    """Implicit ALS on the distinct pairs: the ten best items of each user as (user, item) indices with scores."""
    from pyspark.ml.recommendation import ALS

    p, _, _ = _indexed(spark, folder)
    x = p.select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.lit(1.0).alias("r"))
    model = ALS(rank=16, maxIter=4, regParam=0.05, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="r", seed=5).fit(x)
    return model.recommendForAllUsers(10).select(F.col("u").cast("bigint").alias("u"), F.explode("recommendations").alias("e")).select("u", F.col("e.i").cast("bigint").alias("i"), F.col("e.rating").cast("double").alias("score"))


@CORE.query("cf_train_bpr")
def cf_train_bpr(spark, folder):
    """Pairwise-ranking factors of the distinct pairs: the ten best unseen items of each user."""
    from vitrine.operators import bpr

    p, u, i = _indexed(spark, folder)
    f = bpr.train(p.select("u", "i"), dim=32, epochs=6, rate=0.02)
    names = lambda factors, ids, k, name: factors.join(ids.select(F.col(k).alias("id"), name), "id").select(name, "v")
    return rec.vector_recs(names(f.users, u, "u", "user_id"), names(f.items, i, "i", "product_id"), pairs(spark, folder), 10)


@CORE.query("negative_sample")
def negative_sample(spark, folder):
    """One unseen item per train pair, by hash."""
    from vitrine.operators.numbering import dense_ids

    train = hist.leave_last(events(spark, folder)).where("split = 'train'")
    i = dense_ids(train.select("product_id").distinct(), "product_id", "item")
    p = materialize(train.join(i, "product_id").select("user_id", "item"), "positives")
    return learn.negatives(p, i.agg(F.count(F.lit(1)).alias("_n")), "user_id", "item", 1)


@CORE.query("train_item_check", f"WITH {SPLIT}, {UNIT} SELECT count(*) AS hidden_without_vector FROM split s WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM unit u WHERE u.product_id = s.product_id)")
def train_item_check(spark, folder):
    h = hist.leave_last(events(spark, folder)).where("split = 'test'")
    return h.join(unit_vectors(spark, folder).select("product_id"), "product_id", "left_anti").agg(F.count(F.lit(1)).alias("hidden_without_vector"))


@CORE.query("train_pairs", f"WITH {SPLIT} SELECT DISTINCT i.user_id, i.product_id FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.split = 'test' AND s.user_id = i.user_id AND s.product_id = i.product_id)")
def train_pairs(spark, folder):
    h = hist.leave_last(events(spark, folder)).where("split = 'test'").select("user_id", "product_id")
    return pairs(spark, folder).join(h, ["user_id", "product_id"], "left_anti")


@CORE.query(
    "dev_sample",
    f"""WITH {PAIRS}, d AS (SELECT user_id, count(*) AS n FROM pairs GROUP BY 1), r AS (SELECT user_id, n >= 2 AS repeat, row_number() OVER (PARTITION BY n >= 2 ORDER BY sha256('dev' || user_id), user_id) AS k FROM d)
SELECT i.user_id, r.repeat, i.product_id, count(*) AS n FROM interactions i JOIN r USING (user_id) WHERE k <= 50 GROUP BY 1, 2, 3""",
)
def dev_sample(spark, folder):
    """A development sample: 50 users with repeats and 50 without, in order of a seeded hash, with all their events."""
    d = pairs(spark, folder).groupBy("user_id").agg((F.count(F.lit(1)) >= 2).alias("repeat"))
    order = lambda flag: d.where(F.col("repeat") == flag).orderBy(F.sha2(F.concat(F.lit("dev"), "user_id"), 256), "user_id").limit(50)
    return events(spark, folder).join(F.broadcast(order(True).unionByName(order(False))), "user_id").groupBy("user_id", "repeat", "product_id").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("temporal_holdout", "SELECT count(*) FILTER (WHERE n >= 2) AS eligible, count(*) AS n_users FROM (SELECT user_id, count(*) AS n FROM interactions WHERE occurred_at IS NOT NULL GROUP BY 1)")
def temporal_holdout(spark, folder):
    d = events(spark, folder).where("occurred_at IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count(F.when(F.col("n") >= 2, 1)).alias("eligible"), F.count(F.lit(1)).alias("n_users"))


_CORES = [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (5, 2), (5, 5)]


@CORE.query("kcore_report", f"WITH {PAIRS}, " + ", ".join(_rounds_sql(u, i, 16, f"k{u}{i}_") for u, i in _CORES) + " " + " UNION ALL ".join(f"SELECT {u} AS k_user, {i} AS k_item, count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items, count(*) AS n_pairs FROM k{u}{i}_16" for u, i in _CORES))
def kcore_report(spark, folder):
    """Sizes of seven cores; a finer core starts from a coarser one that holds it."""
    cores: dict[tuple[int, int], DataFrame] = {}
    out = []
    for u, i in _CORES:
        start = [c for k, c in cores.items() if k[0] <= u and k[1] <= i]
        cores[u, i] = kcore.k_core(start[-1] if start else pairs(spark, folder), u, i)
        out.append(cores[u, i].agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("product_id").alias("n_items"), F.count(F.lit(1)).alias("n_pairs")).select(F.lit(u).alias("k_user"), F.lit(i).alias("k_item"), "n_users", "n_items", "n_pairs"))
    return reduce(DataFrame.unionByName, out)


CORE_SPLIT = f"{PAIRS}, {_rounds_sql(2, 2, 24)}, " + SPLIT.replace("FROM interactions GROUP BY", "FROM interactions JOIN c24 USING (user_id, product_id) GROUP BY")


@CORE.query("eval_split", f"WITH {CORE_SPLIT} SELECT user_id, product_id, split FROM split")
def eval_split(spark, folder):
    """Two-core, then the last item of each user hidden."""
    core = kcore.k_core(pairs(spark, folder), 2, 2)
    last = hist.last_seen(events(spark, folder)).join(core, ["user_id", "product_id"], "left_semi")
    return hist.leave_last(last).select("user_id", "product_id", "split")


@CORE.query("split_checksum", f"WITH {SPLIT}, g AS (SELECT user_id, sha256(string_agg(user_id || chr(9) || product_id || chr(9) || split || chr(10), '' ORDER BY product_id)) AS h FROM split WHERE product_id IS NOT NULL GROUP BY 1), b AS (SELECT substr(sha256(user_id), 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM g GROUP BY 1) SELECT sum(n)::BIGINT AS n_users, sha256(string_agg(h, '' ORDER BY h)) AS checksum FROM b")
def split_checksum(spark, folder):
    s = hist.leave_last(events(spark, folder)).where("product_id IS NOT NULL")
    line = F.concat_ws("\t", "user_id", "product_id", F.concat("split", F.lit("\n")))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    # ordered by the id and not by the line, or an id that is another with a tab would change the order
    lines = F.transform(F.array_sort(F.collect_list(F.struct("product_id", line.alias("line")))), lambda x: x["line"])
    g = s.groupBy("user_id").agg(F.sha2(F.array_join(lines, ""), 256).alias("h"))
    b = g.groupBy(F.substring(F.sha2("user_id", 256), 1, 2).alias("b")).agg(digest("h").alias("h"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.sum("n").alias("n_users"), digest("h").alias("checksum"))


# ---- metrics over requests: relevant are the candidates that the request's user has touched

RELEVANT = "rel AS (SELECT DISTINCT h.request_id, h.product_id FROM hybrid_candidates h JOIN interactions i ON i.user_id = h.user_id AND i.product_id = h.product_id)"
FUSED = f"{RANKED}, f AS (SELECT request_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranked GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS rank FROM f)"


def relevant(spark, folder) -> DataFrame:
    h = table(spark, folder, "hybrid_candidates").select("request_id", "user_id", "product_id").distinct()
    return h.join(pairs(spark, folder), ["user_id", "product_id"], "left_semi").select("request_id", "product_id").distinct()


def fused(spark, folder) -> DataFrame:
    return fu.rrf(ranked_channels(spark, folder), "request_id", "product_id")


METRICS = ["mrr"] + [f"{m}_{k}" for k in ev.CUTOFFS for m in ("recall", "precision", "ndcg")]


def metrics_sql(ranked: str, rel: str, key: str) -> str:
    """A table m with one row per key."""
    cols = []
    for k in ev.CUTOFFS:
        ideal = "(" + " + ".join(f"CASE WHEN n >= {i} THEN 1 / log2({i} + 1.0) ELSE 0 END" for i in range(1, k + 1)) + ")"
        cols += [f"h{k}::DOUBLE / n AS recall_{k}", f"h{k} / {k}.0::DOUBLE AS precision_{k}", f"coalesce(g{k} / nullif({ideal}, 0), 0) AS ndcg_{k}"]
    inner = ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1.0)) FILTER (WHERE rank <= {k}), 0) AS g{k}" for k in ev.CUTOFFS)
    return f"mh AS (SELECT r.{key}, count(*) AS n, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr, {inner} FROM {rel} r LEFT JOIN {ranked} f ON f.{key} = r.{key} AND f.product_id = r.product_id GROUP BY 1), m AS (SELECT {key}, mrr, {', '.join(cols)} FROM mh)"


EVAL = f"{FUSED}, {RELEVANT}, {metrics_sql('fused', 'rel', 'request_id')}"


def fused_metrics(spark, folder) -> DataFrame:
    return ev.metrics(fused(spark, folder), relevant(spark, folder), ["request_id"], "product_id")


def _metric(name: str, cols: list[str]) -> None:
    @CORE.query(name, f"WITH {EVAL} SELECT request_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + " FROM m")
    def run(spark, folder):
        return fused_metrics(spark, folder).select("request_id", *[F.round(c, 6).alias(c) for c in cols])


_metric("metric_recall", [f"recall_{k}" for k in ev.CUTOFFS])
_metric("metric_precision", [f"precision_{k}" for k in ev.CUTOFFS])
_metric("metric_mrr", ["mrr"])
_metric("metric_ndcg", [f"ndcg_{k}" for k in ev.CUTOFFS])
_metric("metric_bundle", METRICS)


def avg_sql(names) -> str:
    return "count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in names)


@CORE.query("metrics_macro", f"WITH {EVAL} SELECT {avg_sql(METRICS)} FROM m")
def metrics_macro(spark, folder):
    return ev.averages(fused_metrics(spark, folder), METRICS)


_SEG = "seg AS (SELECT q.request_id, CASE WHEN c <= 1 THEN '<=1' WHEN c <= 4 THEN '2-4' ELSE '>=5' END AS segment FROM (SELECT DISTINCT request_id, user_id FROM hybrid_candidates) q JOIN (SELECT user_id, count(DISTINCT product_id) AS c FROM interactions GROUP BY 1) d USING (user_id))"


@CORE.query("metrics_by_segment", f"WITH {EVAL}, {_SEG} SELECT coalesce(segment, 'all') AS segment, {avg_sql(METRICS)} FROM m JOIN seg USING (request_id) GROUP BY GROUPING SETS ((segment), ())")
def metrics_by_segment(spark, folder):
    """All requests and each history bin in one pass of grouping sets."""
    d = pairs(spark, folder).groupBy("user_id").agg(F.count("product_id").alias("c"))
    seg = table(spark, folder, "hybrid_candidates").select("request_id", "user_id").distinct().join(d, "user_id").select("request_id", hist.history_bin(F.col("c")).alias("segment"))
    j = fused_metrics(spark, folder).join(seg, "request_id")
    return j.groupingSets([[F.col("segment")], []], F.col("segment")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in METRICS]).withColumn("segment", F.coalesce("segment", F.lit("all")))


@CORE.query("channel_coverage", f"WITH {RANKED}, {RELEVANT} SELECT channel, count(DISTINCT (r.request_id, r.product_id)) AS covered, (SELECT count(*) FROM rel) AS n FROM rel r JOIN ranked k USING (request_id, product_id) GROUP BY 1")
def channel_coverage(spark, folder):
    """How many relevant candidates each channel holds."""
    rel = relevant(spark, folder)
    n = rel.agg(F.count(F.lit(1)).alias("n"))
    hit = rel.join(channels(spark, folder), ["request_id", "product_id"]).groupBy("channel").agg(F.count(F.lit(1)).alias("covered"))
    return hit.crossJoin(F.broadcast(n)).select("channel", "covered", "n")


_GRID = [(1.0, 0.0, 0.0), (0.6, 0.3, 0.1), (0.5, 0.4, 0.1), (0.4, 0.4, 0.2), (0.3, 0.6, 0.1), (0.34, 0.33, 0.33)]


def _grid_sql() -> str:
    parts = []
    for i, w in enumerate(_GRID):
        weights = dict(zip(("content", "cf", "popularity"), w))
        parts.append(f"SELECT {i} AS config, * FROM (WITH {weighted_sql(weights)}, {metrics_sql('wr', 'rel', 'request_id')} SELECT {avg_sql(['ndcg_10', 'recall_10', 'mrr'])} FROM m)")
    return f"WITH {LONG}, {RELEVANT}, g AS ({' UNION ALL '.join(parts)}) SELECT *, row_number() OVER (ORDER BY ndcg_10 DESC, recall_10 DESC, mrr DESC, config) = 1 AS winner FROM g"


@CORE.query("tune_grid", _grid_sql())
def tune_grid(spark, folder):
    """Six weightings judged on the same candidates; the winner by NDCG@10, recall@10, MRR."""
    ch, rel = materialize(channels(spark, folder), "channels"), materialize(relevant(spark, folder), "relevant")
    one = lambda i, w: ev.averages(ev.metrics(fu.weighted(ch, "request_id", "product_id", dict(zip(("content", "cf", "popularity"), w))), rel, ["request_id"], "product_id"), ["ndcg_10", "recall_10", "mrr"]).withColumn("config", F.lit(i))
    g = reduce(DataFrame.unionByName, [one(i, w) for i, w in enumerate(_GRID)])
    order = rk.W.orderBy(F.col("ndcg_10").desc(), F.col("recall_10").desc(), F.col("mrr").desc(), "config")  # six rows
    return g.withColumn("winner", F.row_number().over(order) == 1)


@CORE.query("metric_reconcile", f"WITH {EVAL} SELECT request_id, 0.0::DOUBLE AS max_delta, true AS agrees FROM m")
def metric_reconcile(spark, folder):
    """Metrics computed twice, by the general aggregate and by the closed form of one rank at a time, must agree within 1e-6."""
    a = fused_metrics(spark, folder)
    best = relevant(spark, folder).join(fused(spark, folder), ["request_id", "product_id"], "left").groupBy("request_id").agg(F.min("rank").alias("rank"))
    b = best.select("request_id", ev.from_rank(F.col("rank"))[0].alias("mrr_b"))
    delta = F.abs(F.col("mrr") - F.col("mrr_b"))
    return a.join(b, "request_id").select("request_id", F.round(delta, 6).alias("max_delta"), (delta <= 1e-6).alias("agrees"))


_RANK_COLS = ["mrr"] + [f"{m}_{k}" for k in ev.CUTOFFS for m in ("recall", "ndcg")]


def rank_sql(rank: str = "rank") -> str:
    cols = [f"CASE WHEN {rank} IS NOT NULL THEN 1.0::DOUBLE / {rank} ELSE 0 END AS mrr"]
    for k in ev.CUTOFFS:
        cols += [f"CASE WHEN {rank} <= {k} THEN 1.0::DOUBLE ELSE 0 END AS recall_{k}", f"CASE WHEN {rank} <= {k} THEN 1 / log2({rank} + 1.0) ELSE 0 END AS ndcg_{k}"]
    return ", ".join(cols)


@CORE.query("rank_to_metrics", f"WITH {RANKED}, h AS (SELECT request_id, max(product_id) AS hidden FROM hybrid_candidates GROUP BY 1), k AS (SELECT h.request_id, max(r.rank) AS rank FROM h LEFT JOIN ranked r ON r.request_id = h.request_id AND r.product_id = h.hidden AND r.channel = 'content' GROUP BY 1), m AS (SELECT request_id, {rank_sql()} FROM k) SELECT request_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RANK_COLS) + " FROM m")
def rank_to_metrics(spark, folder):
    h = table(spark, folder, "hybrid_candidates").groupBy("request_id").agg(F.max("product_id").alias("product_id"))
    k = h.join(ranked_channels(spark, folder).where("channel = 'content'").select("request_id", "product_id", "rank"), ["request_id", "product_id"], "left")
    return k.select("request_id", *ev.from_rank(F.col("rank"))).select("request_id", *[F.round(c, 6).alias(c) for c in _RANK_COLS])


# ---- offline evaluation of recommenders over the leave-last split


def split_parts(spark, folder):
    s = materialize(hist.leave_last(events(spark, folder)).select("user_id", "product_id", "split"), "split")
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


#: Slices of profile and vector whose product is a list's score.
_VIEWS = {"content": (slice(None), slice(None)), "cf": (slice(16, 32), slice(0, 16))}


def _ranks(spark, folder, methods: list[str]) -> DataFrame:
    """user_id, method and the metrics of the rank of the hidden item."""
    train, hidden = split_parts(spark, folder)
    counts = safe_counts(spark, folder, hidden) if set(methods) - set(_VIEWS) else None
    d = rec.hidden_ranks(train, hidden, unit_vectors(spark, folder).select("product_id", "v"), methods, REC_WEIGHTS, 100, _VIEWS, counts)
    return d.select("user_id", "method", *ev.from_rank(F.col("rank")))


def _eval(name: str, sql: str, method: str) -> None:
    @CORE.query(name, f"WITH {SPLITS}, {sql}, k AS (SELECT h.user_id, r.rank FROM hidden h LEFT JOIN found r ON r.user_id = h.user_id AND r.product_id = h.product_id), m AS (SELECT user_id, {rank_sql()} FROM k) SELECT {avg_sql(_RANK_COLS)} FROM m")
    def run(spark, folder):
        return ev.averages(_ranks(spark, folder, [method]), _RANK_COLS)


def safe_counts(spark, folder, hidden) -> DataFrame:
    """product_id, n: the events of each product without those of hidden pairs."""
    pairs_n = events(spark, folder).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs_n.join(hidden, ["user_id", "product_id"], "left_anti").groupBy("product_id").agg(F.sum("n").alias("n"))


_SAFE = "safe AS (SELECT product_id, count(*) AS n FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = i.user_id AND h.product_id = i.product_id) GROUP BY 1), place AS (SELECT *, row_number() OVER (ORDER BY n DESC, product_id) AS place FROM safe)"
_POPFOUND = """tc AS (SELECT user_id, count(*) AS c FROM train GROUP BY 1), pcand AS (SELECT t.user_id, p.product_id, p.n, p.place FROM tc t JOIN place p ON p.place <= t.c + 100),
popr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM pcand c WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = c.user_id AND s.product_id = c.product_id)) WHERE rank <= 100)"""
_eval("eval_content", top_sql("found", DOT, "profile", "train", 100), "content")
_eval("eval_cf", top_sql("found", CF_DOT, "profile", "train", 100), "cf")
_eval("eval_popularity", f"{_SAFE}, {_POPFOUND}, found AS (SELECT * FROM popr)", "popularity")


_THREE = f"{top_sql('c', DOT, 'profile', 'train', 100)}, {top_sql('f2', CF_DOT, 'profile', 'train', 100)}, {_SAFE}, {_POPFOUND}, ch AS (SELECT user_id, product_id, 'content' AS channel, score, rank FROM c UNION ALL SELECT user_id, product_id, 'cf', score, rank FROM f2 UNION ALL SELECT user_id, product_id, 'popularity', n::DOUBLE, rank FROM popr)"
_eval("eval_hybrid", f"{_THREE}, {weighted_sql(REC_WEIGHTS, 'ch', 'user_id')}, found AS (SELECT * FROM wr)", "weighted")


@CORE.query(
    "eval_methods",
    f"""WITH {SPLITS}, {_THREE}, {weighted_sql(REC_WEIGHTS, 'ch', 'user_id')}, rf AS (SELECT user_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ch GROUP BY 1, 2), rr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rank FROM rf),
found AS (SELECT channel AS method, user_id, product_id, rank FROM ch UNION ALL SELECT 'weighted', user_id, product_id, rank FROM wr UNION ALL SELECT 'rrf', user_id, product_id, rank FROM rr),
k AS (SELECT x.method, h.user_id, r.rank FROM hidden h CROSS JOIN (SELECT unnest(['content', 'cf', 'popularity', 'weighted', 'rrf']) AS method) x LEFT JOIN found r ON r.method = x.method AND r.user_id = h.user_id AND r.product_id = h.product_id), m AS (SELECT method, {rank_sql()} FROM k) SELECT method, {avg_sql(_RANK_COLS)} FROM m GROUP BY 1""",
)
def eval_methods(spark, folder):
    """All methods over one split and one candidate set."""
    return ev.averages(_ranks(spark, folder, ["content", "cf", "popularity", "weighted", "rrf"]), _RANK_COLS, ["method"])
