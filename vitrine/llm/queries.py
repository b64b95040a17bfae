"""The llm queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.times import utc_day
from vitrine.llm import LLM, fusion_rank
from vitrine.llm import packing
from vitrine.llm import same_product as sp
from vitrine.llm import similar_vectors as sv
from vitrine.llm import text_quality as tq
from vitrine.llm import together as tg
from vitrine.llm import tokens
from vitrine.sources.tables import table


@LLM.query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sp.same_product_pairs(table(spark, folder, "products"))


@LLM.query("p1_groups")
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing with the group of listings that sell the same article."""
    return sp.group_listings(table(spark, folder, "products"))


P3_SQL = """
WITH c AS (
  SELECT request_id, product_id,
    max(CASE WHEN content_present AND isfinite(content_raw_score) THEN content_raw_score END) AS content,
    max(CASE WHEN cf_present AND isfinite(cf_raw_score) THEN cf_raw_score END) AS cf,
    max(CASE WHEN popularity_present AND isfinite(popularity_raw_score) THEN popularity_raw_score END) AS popularity
  FROM hybrid_candidates WHERE request_id IS NOT NULL AND product_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, count(*) OVER q AS n,
    rank() OVER (q ORDER BY content DESC NULLS LAST) + (count(*) OVER (PARTITION BY request_id, content) - 1) / 2.0 AS r1,
    rank() OVER (q ORDER BY cf DESC NULLS LAST) + (count(*) OVER (PARTITION BY request_id, cf) - 1) / 2.0 AS r2,
    rank() OVER (q ORDER BY popularity DESC NULLS LAST) + (count(*) OVER (PARTITION BY request_id, popularity) - 1) / 2.0 AS r3
  FROM c WINDOW q AS (PARTITION BY request_id)),
p AS (SELECT request_id, product_id, round(
    n - CASE WHEN content IS NULL THEN (n + 1) * 0.5::DOUBLE ELSE r1::DOUBLE END
    + n - CASE WHEN cf IS NULL THEN (n + 1) * 0.5::DOUBLE ELSE r2::DOUBLE END
    + n - CASE WHEN popularity IS NULL THEN (n + 1) * 0.5::DOUBLE ELSE r3::DOUBLE END, 9) AS points FROM r)
SELECT request_id, product_id, points, row_number() OVER (PARTITION BY request_id ORDER BY points DESC, product_id) AS place FROM p
"""


@LLM.query("p3_ranking", P3_SQL)
def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    channels = {c: (f"{c}_raw_score", f"{c}_present") for c in ("content", "cf", "popularity")}
    rows = fusion_rank.candidates(table(spark, folder, "hybrid_candidates"), "request_id", "product_id", channels)
    return fusion_rank.borda(rows, dict.fromkeys(channels, 1.0)).select(F.col("request").alias("request_id"), F.col("item").alias("product_id"), "points", "place")


P4_SQL = """
WITH b AS (SELECT DISTINCT user_id, epoch_us(occurred_at) // 86400000000 AS d, product_id FROM interactions
           WHERE user_id IS NOT NULL AND product_id IS NOT NULL AND occurred_at IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS big_n FROM (SELECT DISTINCT user_id, d FROM b)),
s AS (SELECT product_id, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS n_ab FROM b x JOIN b y ON x.user_id = y.user_id AND x.d = y.d AND x.product_id < y.product_id GROUP BY 1, 2 HAVING count(*) >= {least}),
r AS (SELECT a, b, n_ab, sa.n AS n_a, sb.n AS n_b, n_ab * big_n / (sa.n::DOUBLE * sb.n) AS ratio FROM p JOIN s sa ON sa.product_id = a JOIN s sb ON sb.product_id = b, t)
"""


def _together(spark: SparkSession, folder: str, least: int, ratio: float) -> DataFrame:
    return tg.together(table(spark, folder, "interactions"), "user_id", "product_id", utc_day(F.col("occurred_at")), least, ratio)


@LLM.query("p4_found", P4_SQL.format(least=8) + "SELECT a AS product_id_a, b AS product_id_b FROM r WHERE ratio >= 30")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder, 8, 30.0).select(F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"))


@LLM.query("p4_pairs", P4_SQL.format(least=3) + "SELECT a AS product_id_a, b AS product_id_b, n_ab, n_a, n_b, round(ratio, 6) AS ratio FROM r")
def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with at least 3 shared baskets, whatever its ratio to chance."""
    d = _together(spark, folder, 3, 0.0)
    return d.select(F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"), "n_ab", "n_a", "n_b", F.round("ratio", 6).alias("ratio"))


@LLM.query("p4_all_pairs", P4_SQL.format(least=1) + "SELECT a AS product_id_a, b AS product_id_b, n_ab, n_a, n_b, round(ratio, 6) AS ratio FROM r")
def p4_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair that shares a basket, however few and whatever its ratio to chance: the whole result that p4_pairs and p4_found cut."""
    d = _together(spark, folder, 1, 0.0)
    return d.select(F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"), "n_ab", "n_a", "n_b", F.round("ratio", 6).alias("ratio"))


@LLM.query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    near = sv.similar_pairs(table(spark, folder, "product_vectors"), "product_id", "embedding", 0.9)
    return near.select(F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"))


@LLM.query("p7_neighbours")
def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar products of every product with a valid vector."""
    d = sv.similar(table(spark, folder, "product_vectors"), "product_id", "embedding")
    return d.select(F.col("item").alias("product_id"), F.col("other").alias("neighbour_id"), "cosine", "place")


@LLM.query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return tq.not_prose(table(spark, folder, "documents"), table(spark, folder, "common_words"), table(spark, folder, "doc_labels"))


@LLM.query("p10_stats")
def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and the verdict of every document."""
    return tq.text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"), labels=table(spark, folder, "doc_labels"))


@LLM.query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


@LLM.query("p8_roundtrip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return tokens.decode(tokens.encode(table(spark, folder, "documents")))


@LLM.query("p9_containers")
def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, folder, "documents")), table(spark, folder, "pack_sizes"))


@LLM.query("p9_fill")
def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and used share of each capacity."""
    used = p9_containers(spark, folder).groupBy("pack_name").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    sizes = table(spark, folder, "pack_sizes").select("pack_name", "capacity_tokens")
    return used.join(F.broadcast(sizes), "pack_name").select("pack_name", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("used_share"))
