"""p2, p5 and p6: feature table, per-key results under skew, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import feature_table as ft
from vitrine.operators import orphans as orp
from vitrine.operators import skew
from vitrine.queries import CORE
from vitrine.sources.tables import table

# fixed values: the parts that the 245 listed event types are made of
FAMILIES = ["view", "click", "add_to_cart", "purchase", "review"]
SURFACES = ["banner", "basket", "brand_page", "detail", "home", "mail", "quiz", "search", "similar", "store_page", "trending", "wishlist"]
DEVICES = ["android", "ios", "tablet", "web"]
LISTED = [*FAMILIES, *(f"{f}.{s}.{d}" for f in FAMILIES for s in SURFACES for d in DEVICES)]


def _p2_sql() -> str:
    """One row per user; a column triple for each listed type and for the rest."""
    parts = []
    for t in [*LISTED, "unlisted"]:
        stem = t.replace(".", "_")
        parts.append(f"count(*) FILTER (WHERE k = '{t}') AS {stem}_n, coalesce(round(sum(amount) FILTER (WHERE k = '{t}'), 4), 0.0) AS {stem}_total, max(us) FILTER (WHERE k = '{t}') AS {stem}_latest_us")
    return f"""
WITH e AS (
  SELECT user_id, product_id, event_type, occurred_at,
         max(CASE WHEN NOT isnan(event_value) AND event_value >= 0 AND event_value <= 1e6 THEN event_value END) AS amount
  FROM interactions WHERE user_id IS NOT NULL GROUP BY ALL),
d AS (SELECT e.user_id, coalesce(t.event_type, 'unlisted') AS k, amount, epoch_us(occurred_at) AS us FROM e LEFT JOIN event_types t USING (event_type))
SELECT user_id, {", ".join(parts)} FROM d GROUP BY user_id"""


@CORE.query("p2_features", _p2_sql())
def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    types = ft.known_types(table(spark, folder, "event_types"))
    return ft.feature_table(table(spark, folder, "interactions"), types)


@CORE.query(
    "p2_states",
    """
WITH e AS (
  SELECT user_id, product_id, event_type, occurred_at,
         max(CASE WHEN NOT isnan(event_value) AND event_value >= 0 AND event_value <= 1e6 THEN event_value END) AS amount
  FROM interactions WHERE user_id IS NOT NULL GROUP BY ALL)
SELECT user_id, coalesce(t.event_type, '(unlisted)') AS kind, count(*) AS n, coalesce(round(sum(amount), 4), 0.0) AS total, max(epoch_us(occurred_at)) AS latest_us
FROM e LEFT JOIN event_types t USING (event_type) GROUP BY 1, 2
""",
)
def p2_states(spark: SparkSession, folder: str) -> DataFrame:
    """The sparse states of two dataset versions kept apart, merged, in long form. An event belongs to the version that delivered it first."""
    types = ft.known_types(table(spark, folder, "event_types"))
    rows = table(spark, folder, "interactions")
    events = ft.distinct_events(rows, "user_id", "product_id", "event_type", "occurred_at", "event_value")
    old = ft.sparse_states(events.where(F.col("at") < F.lit("2025-01-01").cast("timestamp")), types)
    new = ft.sparse_states(events.where(F.coalesce(F.col("at") >= F.lit("2025-01-01").cast("timestamp"), F.lit(True))), types)
    names = F.array(*[F.lit(t) for t in types], F.lit("(unlisted)"))
    cells = ft.merge_states(old, new).select("entity", F.explode("state").alias("c"))
    return cells.select(F.col("entity").alias("user_id"), F.get(names, F.col("c.idx")).alias("kind"), F.col("c.n").alias("n"), F.round("c.total", 4).alias("total"), F.unix_micros("c.latest").alias("latest_us"))


@CORE.query(
    "p5_found",
    """
SELECT 'product_id' AS field, product_id AS key_value FROM interactions WHERE product_id IS NOT NULL GROUP BY product_id
HAVING count(*) >= 0.01 * (SELECT count(*) FROM interactions)
UNION ALL
SELECT 'user_id', user_id FROM interactions WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM interactions)
""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.heavy_keys(table(spark, folder, "interactions"), ["product_id", "user_id"], 0.01).select("field", "key_value")


def _p5_sql(key: str, partner: str) -> str:
    return f"""
WITH i AS (SELECT * FROM interactions WHERE {key} IS NOT NULL),
m AS (SELECT {key}, event_type, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, event_type) AS r FROM i WHERE event_type IS NOT NULL GROUP BY {key}, event_type),
v AS (SELECT {key}, quantile_disc(event_value, 0.5) AS median_value FROM i WHERE NOT isnan(event_value) AND NOT isinf(event_value) GROUP BY {key})
SELECT t.{key}, n_rows, n_partners, latest_us, event_type AS top_event_type, median_value
FROM (SELECT {key}, count(*) AS n_rows, count(DISTINCT {partner}) AS n_partners, max(epoch_us(occurred_at)) AS latest_us FROM i GROUP BY {key}) t
LEFT JOIN m ON m.{key} = t.{key} AND m.r = 1 LEFT JOIN v ON v.{key} = t.{key}
"""


def _p5(spark: SparkSession, folder: str, key: str, partner: str) -> DataFrame:
    d = skew.per_key(table(spark, folder, "interactions"), key, partner, "occurred_at", "event_type", "event_value")
    return d.select(F.col("key").alias(key), "n_rows", "n_partners", F.unix_micros("latest").alias("latest_us"), F.col("top_kind").alias("top_event_type"), F.col("median_amount").alias("median_value"))


@CORE.query("p5_product_stats", _p5_sql("product_id", "user_id"))
def p5_product_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder, "product_id", "user_id")


@CORE.query("p5_user_stats", _p5_sql("user_id", "product_id"))
def p5_user_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder, "user_id", "product_id")


P6_REFS = """
WITH r AS (
  SELECT 'interactions' AS source_table, interaction_id AS record_id, product_id AS key, occurred_at AS ts FROM interactions
  UNION ALL SELECT 'search_events', search_event_id, clicked_product_id, occurred_at FROM search_events),
j AS (
  SELECT r.*, (p.product_id IS NULL OR coalesce(r.ts < p.created_at, false) OR coalesce(r.ts >= p.removed_at, false)) AS dead
  FROM r LEFT JOIN products p ON p.product_id = r.key WHERE r.key IS NOT NULL AND r.key <> '')
"""


def _p6(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    clicks = orp.references(table(spark, folder, "search_events"), "search_events", "search_event_id", "clicked_product_id", "occurred_at")
    events = orp.references(table(spark, folder, "interactions"), "interactions", "interaction_id", "product_id", "occurred_at")
    return events.unionByName(clicks), orp.lifetimes(table(spark, folder, "products"), "product_id", "created_at", "removed_at")


@CORE.query("p6_found", P6_REFS + "SELECT source_table, record_id FROM j WHERE dead")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return orp.orphans(*_p6(spark, folder))


@CORE.query(
    "p6_orphan_counts",
    P6_REFS
    + """SELECT source_table, strftime(make_timestamp(epoch_us(ts)), '%Y-%m') AS month, count(*) AS n_references, count(*) FILTER (WHERE dead) AS n_orphans,
       count(DISTINCT key) FILTER (WHERE dead) AS n_orphan_keys FROM j GROUP BY 1, 2""",
)
def p6_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orp.orphan_counts(*_p6(spark, folder))
