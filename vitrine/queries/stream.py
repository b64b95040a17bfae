"""Streaming queries, drained over the files that are there, and the quality profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.times import micros
from vitrine.queries import CORE
from vitrine.queries.relational import PAIRS, events, pairs, products
from vitrine.queries.search import product_postings, unit_vectors
from vitrine.sources.tables import table
from vitrine.streaming import events as se

_KNOWN = "split_part(event_type, '.', 1) IN ('view', 'click', 'add_to_cart', 'purchase', 'review') AND product_id IN (SELECT product_id FROM products)"


@CORE.query("stream_dedup", "SELECT DISTINCT user_id, product_id, event_type, epoch_us(occurred_at) AS us FROM interactions")
def stream_dedup(spark, folder):
    d = se.drain(se.once(se.read_events(spark, folder)).select(*se.KEY), "append")
    return d.select("user_id", "product_id", "event_type", micros(F.col("occurred_at")).alias("us"))


@CORE.query("stream_user_bounds", "SELECT user_id, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(occurred_at)) AS last_us FROM interactions GROUP BY 1")
def stream_user_bounds(spark, folder):
    d = se.drain(se.bounds(se.read_events(spark, folder)), "complete")
    return d.select("user_id", micros(F.col("first_seen_at")).alias("first_us"), micros(F.col("last_seen_at")).alias("last_us"))


@CORE.query("stream_popularity", "SELECT product_id, count(*) AS n FROM interactions GROUP BY 1")
def stream_popularity(spark, folder):
    return se.drain(se.popularity(se.read_events(spark, folder)), "complete")


@CORE.query("stream_validate", f"SELECT interaction_id, product_id FROM interactions WHERE {_KNOWN}")
def stream_validate(spark, folder):
    return se.drain(se.validate(se.read_events(spark, folder), table(spark, folder, "products")).select("interaction_id", "product_id"), "append")


_PROFILE = f"""WITH {PAIRS}, u AS (SELECT user_id, count(*) AS n FROM pairs GROUP BY 1), s AS (SELECT (SELECT count(*) FROM products) AS n_products, (SELECT count(*) FROM interactions) AS n_events, (SELECT count(*) FROM u) AS n_users,
(SELECT count(*) FROM pairs) AS n_pairs, (SELECT count(DISTINCT product_id) FROM pairs) AS n_items, (SELECT count(*) FROM u WHERE n >= 2) AS users_2, (SELECT count(*) FROM u WHERE n >= 5) AS users_5,
(SELECT count(*) FROM pairs WHERE product_id NOT IN (SELECT product_id FROM products)) AS orphan_pairs, (SELECT round(avg(n), 6) FROM u) AS mean_user_items)
SELECT *, round(n_pairs::DOUBLE / (n_users * n_items), 8) AS density FROM s"""


def profile(spark, folder):
    """One row of catalogue and history statistics."""
    p = pairs(spark, folder)
    u = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.count(F.when(c, 1))
    users = u.agg(F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_pairs"), n(F.col("n") >= 2).alias("users_2"), n(F.col("n") >= 5).alias("users_5"), F.round(F.avg("n"), 6).alias("mean_user_items"))
    known = products(spark, folder).select("product_id", F.lit(1).alias("k"))
    items = p.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).join(known, "product_id", "left").agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("orphan_pairs"))
    size = lambda d, name: F.broadcast(d.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731 - one row
    one = users.crossJoin(F.broadcast(items)).crossJoin(size(products(spark, folder), "n_products")).crossJoin(size(events(spark, folder), "n_events"))
    return one.withColumn("density", F.round(F.col("n_pairs") / (F.col("n_users") * F.col("n_items")), 8))


@CORE.query("quality_profile", _PROFILE)
def quality_profile(spark, folder):
    return profile(spark, folder)


@CORE.query("cf_viability", f"SELECT CASE WHEN users_5 >= 1000 AND density >= 0.001 THEN 'A' WHEN users_2 >= 100 THEN 'B' ELSE 'C' END AS verdict, users_2, users_5, density FROM ({_PROFILE})")
def cf_viability(spark, folder):
    """A: enough repeated users for collaborative filtering, B: as a weak signal, C: not viable."""
    v = F.when((F.col("users_5") >= 1000) & (F.col("density") >= 0.001), "A").when(F.col("users_2") >= 100, "B").otherwise("C")
    return profile(spark, folder).select(v.alias("verdict"), "users_2", "users_5", "density")


@CORE.query("build_index")
def build_index(spark, folder):
    """Postings, unit vectors and hash buckets written to the shared folder; one manifest row per part."""
    from vitrine.operators import vectors as ve
    from vitrine.plans.storage import materialize
    from vitrine.queries.search import _PLANES

    v = unit_vectors(spark, folder)
    parts = {"postings": materialize(product_postings(spark, folder).select("term", "product_id", "class", "tf"), "postings"), "vectors": materialize(v, "vectors"), "buckets": materialize(v.select("product_id", *[ve.bucket(F.col("v"), p).alias(f"b{t}") for t, p in enumerate(_PLANES)]), "buckets")}
    rows = [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows", F.lit(len(d.columns)).alias("n_columns")) for name, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
