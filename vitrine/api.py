"""The engine as Python functions over DataFrames: search, recommendations, similar items, trending, events, lookups.

Arguments are checked like requests: a bad one raises ``Invalid``, a missing user or product ``NotFound``, a missing part ``Unavailable``.
A batch of queries or users is one plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import clean as cl
from vitrine.functions.text import terms
from vitrine.operators import fusion as fu
from vitrine.operators import ingest as ing
from vitrine.operators import keyword as kw
from vitrine.operators import learn
from vitrine.operators import personal as pe
from vitrine.operators import ranking as rk
from vitrine.operators import recommend as rec
from vitrine.operators import vectors as ve
from vitrine.operators.bpr import Factors
from vitrine.operators.learn import Mlp
from vitrine.sources.tables import table

MODES, FUSIONS, METHODS = ("keyword", "semantic", "hybrid"), ("rrf", "weighted", "ltr"), ("content", "cf", "popular", "hybrid")

#: Weights of the channels of hybrid recommendations, scaled over those that a user has.
HYBRID_WEIGHTS = {"content": 0.6, "cf": 0.3, "popularity": 0.1}


class Invalid(ValueError):
    """An argument outside what is allowed."""


class NotFound(LookupError):
    """A user or product that does not exist."""


class Unavailable(RuntimeError):
    """A part that the request needs is missing, such as vectors for semantic search."""


class Engine:
    """Reads the tables of one folder lazily; results are DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, factors: Factors | None = None, ranker: tuple[Mlp, np.ndarray, np.ndarray] | None = None) -> None:
        """factors: users and items by their names (id, v), for the cf channel; ranker: network, mean and deviation of its features."""
        self.spark, self.folder, self.factors, self.ranker = spark, folder, factors, ranker
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def vectors(self) -> DataFrame:
        d = self.table("product_vectors").where(ve.usable(F.col("embedding")))
        return d.select("product_id", ve.unit(F.col("embedding")).alias("v"))

    def search(self, queries: DataFrame, mode: str = "keyword", fusion: str = "rrf", top_k: int = 10, keyword_weight: float = 0.5, personal: dict[str, float] | None = None, gamma: float = 0.2) -> DataFrame:
        """query_id, rank, product_id, title, score of ``queries`` (query_id, query; v for all but keyword; user_id for personal).

        fusion "ltr" re-ranks the union of both channels with the ranker. ``personal`` (weights of the signals content and cf) re-ranks the
        whole candidate list by what the user has touched, at most by the share gamma, before it is cut; score is then the final one.
        """
        if mode not in MODES or fusion not in FUSIONS or not 1 <= top_k <= 100 or not 0 <= keyword_weight <= 1:
            raise Invalid("mode, fusion, top_k (1..100) or keyword_weight (0..1)")
        if mode != "keyword" and "v" not in queries.columns:
            raise Unavailable("semantic search needs query vectors in column v")
        if mode == "hybrid" and fusion == "ltr" and self.ranker is None:
            raise Unavailable("no ranker is loaded")
        if personal is not None:
            if not personal or set(personal) - {"content", "cf"} or not 0 <= gamma <= pe.MAX_GAMMA or "user_id" not in queries.columns:
                raise Invalid("personal (weights of content and cf), gamma or user_id")
            self._known(queries)
            if "cf" in personal and self.factors is None:
                raise Unavailable("no factors are loaded")
        depth = rk.candidate_depth(top_k)
        parts = []
        if mode != "semantic":
            index = kw.postings(self.table("products").select("product_id", *kw.FIELDS))
            hits = kw.match_all(kw.query_terms(queries.where(F.size(terms(F.col("query"))) > 0), "query_id", "query"), index, "query_id")
            parts.append(rk.ranked(hits, ["query_id"], "score", "product_id").where(F.col("rank") <= depth).withColumn("channel", F.lit("keyword")))
        if mode != "keyword":
            parts.append(ve.exact_top_k(queries.select("query_id", "v"), self.vectors(), depth).withColumn("channel", F.lit("semantic")))
        if len(parts) == 1:
            fused = parts[0]
        elif fusion == "ltr":
            model, mean, std = self.ranker
            d = learn.candidate_features(parts[0].unionByName(parts[1]), queries.select("query_id", "query"), self.table("products"), depth)
            scaled = d.select("query_id", "product_id", *[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(learn.FEATURES, mean, std)])
            fused = rk.ranked(learn.score_with(scaled, learn.FEATURES, model).select("query_id", "product_id", "score"), ["query_id"], "score", "product_id")
        elif fusion == "rrf":
            fused = fu.rrf(parts[0].unionByName(parts[1]), "query_id", "product_id")
        else:
            w = {"keyword": keyword_weight, "semantic": 1 - keyword_weight}
            fused = fu.weighted(parts[0].unionByName(parts[1]), "query_id", "product_id", w, renormalise=False)
        if personal is not None:
            fused = self._personal(fused, queries.select("query_id", "user_id"), personal, gamma)
        return self._attach(fused.where(F.col("rank") <= top_k), "query_id")

    def _known(self, users: DataFrame) -> None:
        unknown = users.select("user_id").join(self.table("users").select("user_id"), "user_id", "left_anti").limit(1).collect()
        if unknown:
            raise NotFound(unknown[0][0])

    def _seen(self, users: DataFrame) -> DataFrame:
        return self.table("interactions").select("user_id", "product_id").join(users.select("user_id").distinct(), "user_id", "left_semi").distinct()

    def _personal(self, fused: DataFrame, asked: DataFrame, weights: dict[str, float], gamma: float) -> DataFrame:
        """The candidates re-ranked by their affinity to the asking user; a user without a signal keeps the order."""
        d = fused.select("query_id", "product_id", F.col("rank").alias("baseline_rank"), F.col("score").alias("baseline_score")).join(asked, "query_id")
        for signal in weights:
            items = self.vectors() if signal == "content" else self.factors.items.select(F.col("id").alias("product_id"), "v")
            users = rec.profiles(self._seen(asked), items) if signal == "content" else self.factors.users.select(F.col("id").alias("user_id"), "v")
            d = d.join(users.withColumnRenamed("v", "_u"), "user_id", "left").join(items.withColumnRenamed("v", "_i"), "product_id", "left")
            d = d.withColumn(signal, F.when(F.col("_u").isNotNull() & F.col("_i").isNotNull(), ve.dot(F.col("_u"), F.col("_i")))).drop("_u", "_i")
        return pe.rerank(d, "query_id", "product_id", weights, gamma).select("query_id", "product_id", "rank", F.col("final").alias("score"))

    def _attach(self, ranked: DataFrame, key: str) -> DataFrame:
        """Titles after the cut; ranks are renumbered where a product is missing."""
        hit = ranked.join(self.table("products").select("product_id", "title"), "product_id")
        return hit.withColumn("rank", F.row_number().over(rk.W.partitionBy(key).orderBy("rank")).cast("bigint")).select(key, "rank", "product_id", "title", "score")

    def product(self, product_id: str) -> DataFrame:
        d = self.table("products").where(F.col("product_id") == product_id)
        if d.isEmpty():
            raise NotFound(product_id)
        return d

    def similar(self, product_id: str, top_k: int = 10) -> DataFrame:
        self.product(product_id)
        q = self.vectors().where(F.col("product_id") == product_id).select(F.col("product_id").alias("query_id"), "v")
        if q.isEmpty():
            raise Unavailable(f"{product_id} has no vector")
        items = self.vectors().where(F.col("product_id") != product_id)
        return self._attach(ve.exact_top_k(q, items, top_k), "query_id")

    def trending(self, top_k: int = 10) -> DataFrame:
        n = self.table("interactions").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
        return n.join(self.table("products").select("product_id", "title"), "product_id").orderBy(F.col("n").desc(), "product_id").limit(top_k)

    def recommend(self, users: DataFrame, method: str = "content", top_k: int = 10) -> DataFrame:
        """user_id, rank, product_id, title, score for ``users`` (user_id). content and cf are strict (no history, no rows); hybrid weighs
        the channels that a user has as HYBRID_WEIGHTS do."""
        if method not in METHODS or not 1 <= top_k <= 100:
            raise Invalid("method or top_k (1..100)")
        if method == "cf" and self.factors is None:
            raise Unavailable("no factors are loaded")
        self._known(users)
        seen = self._seen(users)
        depth = top_k if method != "hybrid" else rk.candidate_depth(top_k)
        parts = []
        if method in ("content", "hybrid"):
            v = self.vectors()
            parts.append(rec.vector_recs(rec.profiles(seen, v), v, seen, depth).withColumn("channel", F.lit("content")))
        if method == "cf" or (method == "hybrid" and self.factors is not None):
            mine = self.factors.users.select(F.col("id").alias("user_id"), "v").join(users.select("user_id").distinct(), "user_id", "left_semi")
            parts.append(rec.vector_recs(mine, self.factors.items.select(F.col("id").alias("product_id"), "v"), seen, depth).withColumn("channel", F.lit("cf")))
        if method in ("popular", "hybrid"):
            counts = self.table("interactions").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
            p = rec.popular_unseen(users.select("user_id"), seen, rec.popular_places(counts), depth)
            parts.append(p.select("user_id", "product_id", F.col("n").cast("double").alias("score"), "rank", F.lit("popularity").alias("channel")))
        ranked = parts[0] if len(parts) == 1 else fu.weighted(reduce(DataFrame.unionByName, parts), "user_id", "product_id", HYBRID_WEIGHTS)
        return self._attach(ranked.where(F.col("rank") <= top_k), "user_id")

    def append(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """New valid events (known type and product, not stored yet, each once), and rejected ones with their reason."""
        products = self.table("products").select("product_id", F.lit(True).alias("_known"))
        known = events.join(products, "product_id", "left")
        reason = cl.first_reason(("unknown_type", ~F.coalesce(F.substring_index("event_type", ".", 1), F.lit("")).isin(cl.EVENT_TYPES)), ("unknown_product", F.col("_known").isNull()), ("missing_user", F.col("user_id").isNull()), ("missing_time", F.col("occurred_at").isNull()))
        good, bad = ing.route_rejects(known, reason)
        key = ["user_id", "product_id", "event_type", "occurred_at"]
        return ing.insert_ignore(self.table("interactions").select(*key), good.drop("_known"), key), bad.drop("_known")
