"""Scans, sinks, idempotent loading and cleaning."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import clean as cl
from vitrine.functions.times import micros
from vitrine.operators import ingest as ing
from vitrine.plans.storage import materialize
from vitrine.queries import CORE
from vitrine.sources import files
from vitrine.sources.tables import table

S = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def clean_sql(c: str) -> str:
    return f"CASE WHEN lower({strip_sql(c)}) NOT IN ('', 'none', 'null', 'nan', 'n/a') THEN {strip_sql(c)} END"


def collapse_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, '{S}+', ' ', 'g')")


@CORE.query("scan_parquet_project", "SELECT interaction_id, user_id, CASE WHEN isnan(event_value) THEN NULL ELSE event_value END AS event_value, coalesce(isnan(event_value), false) AS is_nan FROM interactions WHERE event_type = 'purchase'")
def scan_parquet_project(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("event_value")
    rows = table(spark, folder, "interactions").where(F.col("event_type") == "purchase")
    return rows.select("interaction_id", "user_id", F.when(~F.isnan(value), value).alias("event_value"), F.coalesce(F.isnan(value), F.lit(False)).alias("is_nan"))


@CORE.query("scan_json", "SELECT product_id, title FROM products")
def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue written as JSON lines and read back with a strict schema."""
    path = files.scratch(spark, "jsonl")
    table(spark, folder, "products").select("product_id", "title").write.option("ignoreNullFields", "false").json(path)
    return files.read_jsonl(spark, path, "product_id string, title string")


@CORE.query("sink_parquet", "SELECT product_id, brand, price FROM products")
def sink_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(table(spark, folder, "products").select("product_id", "brand", "price"), "sink")


@CORE.query("paged_scan", "SELECT product_id, title FROM products ORDER BY product_id LIMIT 50 OFFSET 100")
def paged_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Page 3 of 50 rows in byte order of the id."""
    return table(spark, folder, "products").select("product_id", "title").orderBy("product_id").offset(100).limit(50)


_FP = "sha256(concat_ws(chr(10), product_id, coalesce(title, ''), coalesce(description, ''), coalesce(category, ''), coalesce(subcategory, ''), coalesce(brand, '')))"


# rows are digested, then buckets of them by the first digits of their digests, then the buckets
@CORE.query("catalog_fingerprint", f"WITH r AS (SELECT {_FP} AS h FROM products), b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS g, count(*) AS n FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(g, '' ORDER BY g)) AS fingerprint FROM b")
def catalog_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of the catalogue's text fields that does not depend on row order: rows are digested, then 4,096 buckets of them by their digests, then the buckets."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "category", "subcategory", "brand")]
    rows = table(spark, folder, "products").select(F.sha2(F.concat_ws("\n", "product_id", *fields), 256).alias("h")).withColumn("b", F.substring("h", 1, 3))
    digest = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
    groups = rows.groupBy("b").agg(digest().alias("h"), F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n"), digest().alias("fingerprint"))


@CORE.query("point_lookup", "SELECT product_id, title, brand, price FROM products WHERE product_id IN ('B00001XC67', 'B0FR5JRSU6')")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").where(F.col("product_id").isin("B00001XC67", "B0FR5JRSU6")).select("product_id", "title", "brand", "price")


_SPLIT = "make_timestamp(2025, 1, 1, 0, 0, 0)"


@CORE.query(
    "upsert_latest",
    """WITH o AS (SELECT product_id, title, price, created_at FROM products), i AS (SELECT product_id, upper(title) AS title, price * 2 AS price, updated_at AS created_at FROM products WHERE updated_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00')
SELECT o.product_id, coalesce(i.title, CASE WHEN i.product_id IS NULL THEN o.title END) AS title, CASE WHEN i.product_id IS NULL THEN o.price ELSE i.price END AS price, epoch_us(o.created_at) AS created_us FROM o LEFT JOIN i USING (product_id)""",
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Updated listings replace the stored ones; created_at stays."""
    old = table(spark, folder, "products").select("product_id", F.col("title"), "price", "created_at", "updated_at")
    new = old.where(F.col("updated_at") >= F.lit("2025-01-01").cast("timestamp")).withColumn("title", F.upper("title")).withColumn("price", F.col("price") * 2).withColumn("created_at", F.col("updated_at"))
    merged = ing.latest_wins(old, new, ["product_id"], F.col("updated_at"), keep=["created_at"])
    return merged.select("product_id", "title", "price", micros(F.col("created_at")).alias("created_us"))


@CORE.query(
    "upsert_bounds",
    """SELECT user_id, epoch_us(min(f)) AS first_us, epoch_us(max(l)) AS last_us FROM (SELECT user_id, first_seen_at AS f, last_seen_at AS l FROM users
UNION ALL SELECT user_id, occurred_at, occurred_at FROM interactions) GROUP BY user_id""",
)
def upsert_bounds(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "interactions").groupBy("user_id").agg(F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"))
    d = ing.widen_bounds(table(spark, folder, "users"), seen, "user_id", "first_seen_at", "last_seen_at")
    return d.select("user_id", micros(F.col("first_seen_at")).alias("first_us"), micros(F.col("last_seen_at")).alias("last_us"))


KEY = ["user_id", "product_id", "event_type", "occurred_at"]
_OLD = "(SELECT DISTINCT user_id, product_id, event_type, occurred_at FROM interactions WHERE dataset_version = 'vanity_catalog-v1')"


@CORE.query(
    "insert_ignore",
    f"""SELECT user_id, product_id, event_type, epoch_us(occurred_at) AS us FROM (SELECT DISTINCT user_id, product_id, event_type, occurred_at FROM interactions WHERE dataset_version = 'vanity_catalog-v2') n
WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.user_id = n.user_id AND o.product_id = n.product_id AND o.event_type = n.event_type AND o.occurred_at = n.occurred_at)""",
)
def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "interactions")
    new = ing.insert_ignore(rows.where("dataset_version = 'vanity_catalog-v1'").select(*KEY), rows.where("dataset_version = 'vanity_catalog-v2'").select(*KEY), KEY)
    return new.select("user_id", "product_id", "event_type", micros(F.col("occurred_at")).alias("us"))


@CORE.query(
    "append_events",
    """SELECT i.user_id, i.product_id, i.event_type, epoch_us(i.occurred_at) AS us FROM (SELECT DISTINCT user_id, product_id, event_type, occurred_at FROM interactions) i
WHERE split_part(i.event_type, '.', 1) IN ('view', 'click', 'add_to_cart', 'purchase', 'review') AND EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)""",
)
def append_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a known type for a known product, each once."""
    rows = table(spark, folder, "interactions").select(*KEY).where(F.substring_index("event_type", ".", 1).isin(cl.EVENT_TYPES))
    valid = rows.join(table(spark, folder, "products").select("product_id"), "product_id", "left_semi")
    return valid.dropDuplicates(KEY).select("user_id", "product_id", "event_type", micros(F.col("occurred_at")).alias("us"))


@CORE.query("dup_probe", "SELECT user_id, product_id, event_type, epoch_us(occurred_at) AS us, count(*) AS n FROM interactions GROUP BY ALL HAVING count(*) > 1")
def dup_probe(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "interactions").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.select("user_id", "product_id", "event_type", micros(F.col("occurred_at")).alias("us"), "n")


@CORE.query(
    "ingest_report",
    """SELECT (SELECT count(*) FROM products) AS n_products, (SELECT count(DISTINCT user_id) FROM interactions) AS n_users, count(*) AS n_read,
count(*) FILTER (WHERE p.product_id IS NULL) AS n_orphans, (SELECT count(*) FROM (SELECT DISTINCT user_id, product_id, event_type, occurred_at FROM interactions WHERE product_id IN (SELECT product_id FROM products))) AS n_loaded
FROM interactions i LEFT JOIN products p USING (product_id)""",
)
def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    rows, products = table(spark, folder, "interactions").select(*KEY), table(spark, folder, "products").select("product_id")
    known = products.withColumn("known", F.lit(1))
    # one row per key and product state, then one row
    keyed = rows.join(known, "product_id", "left").groupBy(*KEY, "known").agg(F.count(F.lit(1)).alias("n"))
    counts = keyed.agg(F.sum("n").alias("n_read"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_orphans"), F.count(F.when(F.col("known").isNotNull(), 1)).alias("n_loaded"))
    users = rows.agg(F.countDistinct("user_id").alias("n_users"))
    return counts.crossJoin(F.broadcast(users)).crossJoin(F.broadcast(products.agg(F.count(F.lit(1)).alias("n_products")))).select("n_products", "n_users", "n_read", "n_orphans", "n_loaded")


@CORE.query(
    "search_log",
    f"SELECT search_event_id, user_id, {collapse_sql('lower(query_text)')} AS normalized_query, 'observed' AS label_class, pos AS rank, w AS token FROM (SELECT search_event_id, user_id, query_text, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT *, string_split({collapse_sql('lower(query_text)')}, ' ') AS t FROM search_events WHERE query_text IS NOT NULL))",
)
def search_log(spark: SparkSession, folder: str) -> DataFrame:
    """Search events with their normalised query, exploded to one child row per ranked entry (here the query's words)."""
    q = cl.collapse(F.lower("query_text"))
    rows = table(spark, folder, "search_events").where(F.col("query_text").isNotNull()).select("search_event_id", "user_id", q.alias("normalized_query"), F.lit("observed").alias("label_class"), F.posexplode(F.split(q, " ")).alias("pos", "token"))
    return rows.select("search_event_id", "user_id", "normalized_query", "label_class", (F.col("pos") + 1).cast("bigint").alias("rank"), "token")


@CORE.query("file_checksum")
def file_checksum(spark: SparkSession, folder: str) -> DataFrame:
    return files.checksums(spark, folder, "*.parquet")


# ---- cleaning


@CORE.query("clean_string", f"SELECT product_id, {clean_sql('brand')} AS brand, {clean_sql('subcategory')} AS subcategory FROM products")
def clean_string(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("product_id", cl.clean_string(F.col("brand")).alias("brand"), cl.clean_string(F.col("subcategory")).alias("subcategory"))


@CORE.query("text_list", f"SELECT product_id, list_filter([{clean_sql('category')}, {clean_sql('subcategory')}, {clean_sql('brand')}], lambda x: x IS NOT NULL) AS parts, nullif(concat_ws(' ', nullif({strip_sql('category')}, ''), nullif({strip_sql('brand')}, '')), '') AS joined FROM products")
def text_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("product_id", cl.clean_list(F.array("category", "subcategory", "brand")).alias("parts"), cl.join_text(F.col("category"), F.col("brand")).alias("joined"))


@CORE.query(
    "parse_json_props",
    "SELECT interaction_id, CASE WHEN json_valid(extras_json) THEN json_extract_string(extras_json, '$.has_review_text') END AS has_review_text, CASE WHEN json_valid(extras_json) THEN json_extract_string(extras_json, '$.review_title') END AS review_title FROM interactions",
)
def parse_json_props(spark: SparkSession, folder: str) -> DataFrame:
    m = cl.json_map(F.col("extras_json"))
    return table(spark, folder, "interactions").select("interaction_id", m["has_review_text"].alias("has_review_text"), m["review_title"].alias("review_title"))


@CORE.query("parse_price", "SELECT product_id, price AS price, CASE WHEN isnan(price) THEN NULL ELSE price END AS listed FROM products")
def parse_price(spark: SparkSession, folder: str) -> DataFrame:
    """Prices written as text with currency sign and read back."""
    p = cl.parse_price(F.concat(F.lit(" $"), F.col("price").cast("string")))
    return table(spark, folder, "products").select("product_id", p.alias("price"), F.when(~F.isnan(p), p).alias("listed"))


@CORE.query("parse_rating", "SELECT interaction_id, CASE WHEN NOT isnan(event_value) AND event_value BETWEEN 1 AND 5 THEN event_value END AS rating FROM interactions WHERE starts_with(event_type, 'review')")
def parse_rating(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "interactions").where(F.col("event_type").startswith("review")).select("interaction_id", cl.parse_rating(F.col("event_value")).alias("rating"))


@CORE.query("parse_epoch", "SELECT interaction_id, epoch_us(occurred_at) // 1000 * 1000 AS from_ms, epoch_us(occurred_at) // 1000000 * 1000000 AS from_s FROM interactions")
def parse_epoch(spark: SparkSession, folder: str) -> DataFrame:
    us = micros(F.col("occurred_at"))
    ms, s = F.floor(us / 1000), F.floor(us / 1_000_000)
    return table(spark, folder, "interactions").select("interaction_id", micros(cl.parse_epoch(ms)).alias("from_ms"), micros(cl.parse_epoch(s)).alias("from_s"))


@CORE.query(
    "first_other",
    """SELECT product_id, coalesce(list_filter(c, lambda x: x IS DISTINCT FROM category)[1], c[1]) AS sub FROM (SELECT product_id, category, CASE WHEN json_valid(extras_json) THEN CAST(json_extract(extras_json, '$.categories') AS VARCHAR[]) END AS c FROM products)""",
)
def first_other(spark: SparkSession, folder: str) -> DataFrame:
    cats = F.from_json("extras_json", "categories array<string>")["categories"]
    return table(spark, folder, "products").select("product_id", cl.first_other(cats, F.col("category")).alias("sub"))


@CORE.query(
    "normalize_products",
    f"""SELECT product_id, {clean_sql('title')} AS title, {clean_sql('description')} AS description, {clean_sql('brand')} AS brand, CASE WHEN NOT isnan(price) AND price > 0 THEN price END AS price,
CASE WHEN NOT isnan(average_rating) AND average_rating BETWEEN 1 AND 5 THEN average_rating END AS average_rating, rating_count FROM products WHERE {clean_sql('product_id')} IS NOT NULL AND {clean_sql('title')} IS NOT NULL""",
)
def normalize_products(spark: SparkSession, folder: str) -> DataFrame:
    c = {x: cl.clean_string(F.col(x)) for x in ("product_id", "title", "description", "brand")}
    ok, _ = ing.route_rejects(table(spark, folder, "products"), cl.first_reason(("missing_id", c["product_id"].isNull()), ("missing_title", c["title"].isNull())))
    price = F.when(~F.isnan("price") & (F.col("price") > 0), F.col("price"))
    return ok.select("product_id", *[c[x].alias(x) for x in ("title", "description", "brand")], price.alias("price"), cl.parse_rating(F.col("average_rating")).alias("average_rating"), "rating_count")


_REASON = "CASE WHEN user_id IS NULL OR trim(user_id) = '' THEN 'missing_user' WHEN product_id IS NULL OR trim(product_id) = '' THEN 'missing_item' WHEN split_part(coalesce(event_type, ''), '.', 1) NOT IN ('view', 'click', 'add_to_cart', 'purchase', 'review') THEN 'unknown_type' WHEN occurred_at IS NULL THEN 'missing_time' END"


def _reason():
    return cl.first_reason(
        ("missing_user", F.col("user_id").isNull() | (F.trim("user_id") == "")), ("missing_item", F.col("product_id").isNull() | (F.trim("product_id") == "")),
        ("unknown_type", ~F.substring_index(F.coalesce("event_type", F.lit("")), ".", 1).isin(cl.EVENT_TYPES)), ("missing_time", F.col("occurred_at").isNull()),
    )


@CORE.query("normalize_interactions", f"SELECT interaction_id, user_id, product_id, split_part(event_type, '.', 1) AS family, coalesce(helpful_vote, 0) AS helpful_vote, coalesce(verified_purchase, false) AS verified FROM interactions WHERE {_REASON} IS NULL")
def normalize_interactions(spark: SparkSession, folder: str) -> DataFrame:
    ok, _ = ing.route_rejects(table(spark, folder, "interactions"), _reason())
    return ok.select("interaction_id", "user_id", "product_id", F.substring_index("event_type", ".", 1).alias("family"), F.coalesce("helpful_vote", F.lit(0)).alias("helpful_vote"), cl.truthy(F.col("verified_purchase")).alias("verified"))


@CORE.query("reject_counts", f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM interactions) WHERE reason IS NOT NULL GROUP BY 1")
def reject_counts(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = ing.route_rejects(table(spark, folder, "interactions"), _reason())
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_FIELDS = ["title", "brand", "category", "subcategory", "description"]


@CORE.query("searchable_text", "SELECT product_id, concat_ws(chr(10), " + ", ".join(f"nullif(rtrim(substr({collapse_sql(f)}, 1, 4000)), '')" for f in _FIELDS) + ") AS searchable_text FROM products")
def searchable_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("product_id", cl.searchable_text(*[F.col(f) for f in _FIELDS]).alias("searchable_text"))


@CORE.query("semantic_text", "SELECT product_id, concat_ws(chr(10), " + ", ".join(f"'{f.capitalize()}: ' || nullif({collapse_sql(f)}, '')" for f in _FIELDS) + ") AS semantic_text FROM products")
def semantic_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("product_id", cl.labelled_text(**{f: F.col(f) for f in _FIELDS}).alias("semantic_text"))


@CORE.query("field_presence", "SELECT product_id, " + ", ".join(f"({clean_sql(f)}) IS NOT NULL AS has_{f}" for f in _FIELDS) + " FROM products")
def field_presence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").select("product_id", *[cl.present(F.col(f)).alias(f"has_{f}") for f in _FIELDS])


@CORE.query("product_rows", f"SELECT product_id, nullif({strip_sql('title')}, '') AS title, nullif({strip_sql('brand')}, '') AS brand, coalesce(nullif({strip_sql('currency')}, ''), 'USD') AS currency, CAST(CASE WHEN NOT isnan(price) THEN price END AS DECIMAL(12, 2)) AS price FROM products")
def product_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows shaped for an upsert: blanks null, currency defaulted, prices as decimals."""
    blank = lambda c: F.nullif(cl.strip(F.col(c)), F.lit(""))
    return table(spark, folder, "products").select("product_id", blank("title").alias("title"), blank("brand").alias("brand"), F.coalesce(blank("currency"), F.lit("USD")).alias("currency"), F.when(~F.isnan("price"), F.col("price")).cast("decimal(12,2)").alias("price"))


@CORE.query("asof_history", "SELECT user_id, product_id, epoch_us(occurred_at) AS us FROM interactions WHERE occurred_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'")
def asof_history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "interactions").where(F.col("occurred_at") < F.lit("2025-01-01").cast("timestamp")).select("user_id", "product_id", micros(F.col("occurred_at")).alias("us"))


@CORE.query("semi_filter", "SELECT interaction_id, product_id FROM interactions WHERE product_id IN (SELECT clicked_product_id FROM search_events)")
def semi_filter(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "search_events").select(F.col("clicked_product_id").alias("product_id"))
    return table(spark, folder, "interactions").select("interaction_id", "product_id").join(ids, "product_id", "left_semi").select("interaction_id", "product_id")


@CORE.query("ilike_filter", "SELECT product_id, title FROM products WHERE title ILIKE '%balm%'")
def ilike_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products").where(F.col("title").ilike("%balm%")).select("product_id", "title")


