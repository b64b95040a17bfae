"""Joins, aggregates, rankings and set operations of the reference, posed over the catalogue's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrine.functions.times import micros
from vitrine.operators import history as hist
from vitrine.operators import kcore
from vitrine.operators import ranking as rk
from vitrine.queries import CORE
from vitrine.sources.tables import table

CHANNELS = ("content", "cf", "popularity")
LONG = "long AS (" + " UNION ALL ".join(f"SELECT request_id, product_id, '{c}' AS channel, max({c}_raw_score) AS score FROM hybrid_candidates WHERE {c}_present AND isfinite({c}_raw_score) GROUP BY 1, 2" for c in CHANNELS) + ")"
RANKED = LONG + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, channel ORDER BY score DESC, product_id) AS rank FROM long)"
PAIRS = "pairs AS (SELECT DISTINCT user_id, product_id FROM interactions)"
SEEN = "seen AS (SELECT user_id, product_id, max(occurred_at) AS ts FROM interactions GROUP BY 1, 2)"
SPLIT = SEEN + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, product_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM seen),
split AS (SELECT user_id, product_id, ts, CASE WHEN r = 1 THEN 'test' ELSE 'train' END AS split FROM n WHERE c >= 2)"""


def channels(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, product_id, channel, score: the present finite scores of all channels, each candidate once with its best."""
    df = table(spark, folder, "hybrid_candidates")
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.when(F.col(f"{c}_present"), F.col(f"{c}_raw_score")).alias("score")) for c in CHANNELS])
    long = df.select("request_id", "product_id", F.explode(entries).alias("e")).select("request_id", "product_id", "e.*")
    return long.where(rk.finite(F.col("score"))).groupBy("request_id", "product_id", "channel").agg(F.max("score").alias("score"))


def ranked_channels(spark: SparkSession, folder: str) -> DataFrame:
    return rk.ranked(channels(spark, folder), ["request_id", "channel"], "score", "product_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "interactions")


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return hist.pairs(events(spark, folder))


# ---- joins


@CORE.query("metadata_attach", f"WITH {RANKED} SELECT r.request_id, row_number() OVER (PARTITION BY r.request_id ORDER BY r.rank) AS rank, p.product_id, p.title, p.brand FROM ranked r JOIN products p USING (product_id) WHERE r.channel = 'content' AND r.rank <= 10")
def metadata_attach(spark, folder):
    """Metadata of the ten best, attached after ranking; ranks are renumbered where a product is missing."""
    top = ranked_channels(spark, folder).where((F.col("channel") == "content") & (F.col("rank") <= 10))
    hit = top.join(products(spark, folder).select("product_id", "title", "brand"), "product_id")
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy("rank")).cast("bigint")).select("request_id", "rank", "product_id", "title", "brand")


@CORE.query("orphan_anti", "SELECT interaction_id, product_id FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)")
def orphan_anti(spark, folder):
    return events(spark, folder).select("interaction_id", "product_id").join(products(spark, folder).select("product_id"), "product_id", "left_anti").select("interaction_id", "product_id")


@CORE.query("orphan_semi", "SELECT product_id, count(*) AS n FROM interactions WHERE product_id IN (SELECT product_id FROM products) GROUP BY 1")
def orphan_semi(spark, folder):
    counts = events(spark, folder).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))  # before the join: one row per key is shuffled
    return counts.join(products(spark, folder).select("product_id"), "product_id", "left_semi").select("product_id", "n")


@CORE.query("join_coverage", "WITH a AS (SELECT product_id, count(*) AS n FROM interactions WHERE product_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE a.product_id IS NOT NULL AND p.product_id IS NOT NULL) AS both, count(*) FILTER (WHERE p.product_id IS NULL) AS left_only, count(*) FILTER (WHERE a.product_id IS NULL) AS right_only, round(100.0 * coalesce(sum(a.n) FILTER (WHERE p.product_id IS NOT NULL), 0) / sum(a.n), 4) AS row_match_pct FROM a FULL JOIN products p ON p.product_id = a.product_id")
def join_coverage(spark, folder):
    a = events(spark, folder).where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    j = a.join(products(spark, folder).select("product_id", F.lit(1).alias("p")), "product_id", "full_outer")
    n, p = F.col("n"), F.col("p")
    return j.agg(F.count(F.when(n.isNotNull() & p.isNotNull(), 1)).alias("both"), F.count(F.when(p.isNull(), 1)).alias("left_only"), F.count(F.when(n.isNull(), 1)).alias("right_only"), F.round(100.0 * F.coalesce(F.sum(F.when(p.isNotNull(), n)), F.lit(0)) / F.sum(n), 4).alias("row_match_pct"))


def union_ranks(ranked: DataFrame, names) -> DataFrame:
    """One row per candidate with rank and score of each channel, null where the channel lacks it: a union and one shuffle, no outer joins."""
    cols = [a for c in names for a in (F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank"), F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"{c}_score"))]
    return ranked.where(F.col("channel").isin(list(names))).groupBy("request_id", "product_id").agg(*cols)


def _union_sql(names) -> str:
    cols = ", ".join(f"max(rank) FILTER (WHERE channel = '{c}') AS {c}_rank, max(score) FILTER (WHERE channel = '{c}') AS {c}_score" for c in names)
    return f"WITH {RANKED} SELECT request_id, product_id, {cols} FROM ranked WHERE channel IN ({', '.join(repr(c) for c in names)}) GROUP BY 1, 2"


@CORE.query("union_2ch", _union_sql(CHANNELS[:2]))
def union_2ch(spark, folder):
    return union_ranks(ranked_channels(spark, folder), CHANNELS[:2])


@CORE.query("union_3ch", _union_sql(CHANNELS))
def union_3ch(spark, folder):
    return union_ranks(ranked_channels(spark, folder), CHANNELS)


@CORE.query("seen_filter", "SELECT request_id, product_id FROM (SELECT DISTINCT request_id, user_id, product_id FROM hybrid_candidates) c WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = c.user_id AND i.product_id = c.product_id)")
def seen_filter(spark, folder):
    cand = table(spark, folder, "hybrid_candidates").select("request_id", "user_id", "product_id").distinct()
    return cand.join(pairs(spark, folder), ["user_id", "product_id"], "left_anti").select("request_id", "product_id")


@CORE.query("popularity_train_safe", f"WITH {SPLIT} SELECT product_id, count(*) AS n FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.split = 'test' AND s.user_id = i.user_id AND s.product_id = i.product_id) GROUP BY 1")
def popularity_train_safe(spark, folder):
    """Counts without any repeat of a hidden pair. Events are added up per pair before the anti-join."""
    hidden = hist.leave_last(events(spark, folder)).where("split = 'test'").select("user_id", "product_id")
    n = events(spark, folder).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(hidden, ["user_id", "product_id"], "left_anti").groupBy("product_id").agg(F.sum("n").alias("n"))


def _rounds_sql(ku: int, ki: int, rounds: int, c: str = "c") -> str:
    steps = [f"{c}0 AS (SELECT user_id, product_id FROM pairs)"]
    for i in range(rounds):
        steps.append(f"{c}{i + 1} AS MATERIALIZED (SELECT * FROM {c}{i} WHERE user_id IN (SELECT user_id FROM {c}{i} GROUP BY 1 HAVING count(*) >= {ku}) AND product_id IN (SELECT product_id FROM {c}{i} GROUP BY 1 HAVING count(*) >= {ki}))")
    return ", ".join(steps)


@CORE.query("kcore", f"WITH {PAIRS}, {_rounds_sql(5, 5, 24)} SELECT user_id, product_id FROM c24")
def kcore_query(spark, folder):
    return kcore.k_core(pairs(spark, folder), 5, 5)


@CORE.query("core_events", f"WITH {PAIRS}, {_rounds_sql(3, 2, 24)} SELECT i.user_id, i.product_id, count(*) AS n FROM interactions i JOIN c24 USING (user_id, product_id) GROUP BY 1, 2")
def core_events(spark, folder):
    """Events within the (3, 2)-core, added up per pair before the semi-join."""
    n = events(spark, folder).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(kcore.k_core(pairs(spark, folder), 3, 2), ["user_id", "product_id"], "left_semi")


@CORE.query("dense_index", "SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS idx FROM (SELECT DISTINCT product_id FROM interactions)")
def dense_index(spark, folder):
    """Sorted ids numbered from 0. Ids are range-partitioned by sorting; each range gets its offset from the counts of the ranges before."""
    from vitrine.operators.numbering import dense_ids

    return dense_ids(events(spark, folder).select("product_id").distinct(), "product_id", "idx")


@CORE.query("zero_interaction_items", "SELECT product_id, title FROM products p WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.product_id = p.product_id)")
def zero_interaction_items(spark, folder):
    seen = events(spark, folder).select("product_id").distinct()
    return products(spark, folder).select("product_id", "title").join(seen, "product_id", "left_anti")


@CORE.query("history_titles", "SELECT DISTINCT i.user_id, p.title FROM interactions i JOIN products p USING (product_id) WHERE p.title IS NOT NULL")
def history_titles(spark, folder):
    return pairs(spark, folder).join(products(spark, folder).select("product_id", "title").where("title IS NOT NULL"), "product_id").select("user_id", "title").distinct()


# ---- aggregates


@CORE.query("popularity_counts", "SELECT product_id, count(*) AS n FROM interactions GROUP BY 1")
def popularity_counts(spark, folder):
    return events(spark, folder).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("popularity_topk", "SELECT product_id, n, row_number() OVER (ORDER BY n DESC, product_id) AS rank FROM (SELECT product_id, count(*) AS n FROM interactions WHERE product_id NOT IN (SELECT product_id FROM products WHERE removed_at IS NOT NULL) GROUP BY 1 ORDER BY n DESC, product_id LIMIT 20)")
def popularity_topk(spark, folder):
    gone = products(spark, folder).where("removed_at IS NOT NULL").select("product_id")
    top = popularity_counts(spark, folder).join(gone, "product_id", "left_anti").orderBy(F.col("n").desc(), "product_id").limit(20)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "product_id")).cast("bigint"))  # 20 rows


@CORE.query("trending", "SELECT row_number() OVER (ORDER BY n DESC, product_id) AS rank, product_id, title, n FROM (SELECT product_id, count(*) AS n FROM interactions GROUP BY 1) JOIN products USING (product_id) ORDER BY n DESC, product_id LIMIT 10")
def trending(spark, folder):
    hit = popularity_counts(spark, folder).join(products(spark, folder).select("product_id", "title"), "product_id").orderBy(F.col("n").desc(), "product_id").limit(10)
    return hit.select(F.row_number().over(W.orderBy(F.col("n").desc(), "product_id")).cast("bigint").alias("rank"), "product_id", "title", "n")


@CORE.query("user_bounds", "SELECT user_id, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(occurred_at)) AS last_us FROM interactions GROUP BY 1")
def user_bounds(spark, folder):
    return events(spark, folder).groupBy("user_id").agg(micros(F.min("occurred_at")).alias("first_us"), micros(F.max("occurred_at")).alias("last_us"))


_TABLES = ["products", "users", "interactions", "search_events", "hybrid_candidates", "documents"]


@CORE.query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, folder):
    return reduce(DataFrame.unionByName, [table(spark, folder, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES])


_COLS = ["title", "description", "category", "subcategory", "brand", "store"]


@CORE.query("coverage", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) FILTER (WHERE trim({c}) <> '') AS present, round(100.0 * (count(*) - count(*) FILTER (WHERE trim({c}) <> '')) / count(*), 4) AS missing_pct FROM products" for c in _COLS))
def coverage(spark, folder):
    """Present values per column in one pass."""
    one = products(spark, folder).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.trim(c) != "", 1)).alias(c) for c in _COLS])
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in _COLS]))
    return one.select("n", e.alias("e")).select("e.field", "n", "e.present", F.round(100.0 * (F.col("n") - F.col("e.present")) / F.col("n"), 4).alias("missing_pct"))


@CORE.query("raw_field_stats", """WITH v AS (SELECT extras_json AS j FROM interactions WHERE json_valid(extras_json)), k AS (SELECT unnest(json_keys(j)) AS field, j FROM v)
SELECT field, count(*) AS n, count(*) FILTER (WHERE json_extract_string(j, '$.' || field) IS NOT NULL) AS n_value, (SELECT count(*) FROM v) - count(*) AS n_missing, list_sort(list(DISTINCT json_type(j, '$.' || field))) AS types FROM k GROUP BY 1""")
def raw_field_stats(spark, folder):
    """Keys of raw JSON objects: present, with a value, missing, and their value types."""
    raw = events(spark, folder).select("extras_json").where(F.try_parse_json("extras_json").isNotNull())
    m = raw.select(F.from_json("extras_json", "map<string,string>").alias("m"), F.try_parse_json("extras_json").alias("v"))
    total = m.agg(F.count(F.lit(1)).alias("t"))
    e = m.select("v", F.explode("m").alias("field", "value"))
    kind = F.when(F.col("value").isNull(), "NULL").when(F.col("value").isin("true", "false"), "BOOLEAN").when(F.col("value").rlike("^-?[0-9]+$"), "UBIGINT").when(F.col("value").try_cast("double").isNotNull(), "DOUBLE").otherwise("VARCHAR")
    g = e.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.array_sort(F.collect_set(kind)).alias("types"))
    return g.crossJoin(F.broadcast(total)).select("field", "n", "n_value", (F.col("t") - F.col("n")).alias("n_missing"), "types")


@CORE.query("distinct_counts", f"WITH {PAIRS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items, count(*) AS n_pairs FROM pairs")
def distinct_counts(spark, folder):
    return _sizes(pairs(spark, folder))


def _sizes(p):
    """Users, items and pairs of distinct pairs: two small aggregates instead of one expanded one."""
    users = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count("user_id").alias("n_users"), F.sum("n").alias("n_pairs"))
    return users.crossJoin(F.broadcast(p.select("product_id").distinct().agg(F.count("product_id").alias("n_items")))).select("n_users", "n_items", "n_pairs")


@CORE.query("density_report", f"WITH {PAIRS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items, count(*) AS n_pairs, round(count(*)::DOUBLE / nullif(count(DISTINCT user_id) * count(DISTINCT product_id), 0), 8) AS density, round(1 - count(*)::DOUBLE / nullif(count(DISTINCT user_id) * count(DISTINCT product_id), 0), 8) AS sparsity FROM pairs")
def density_report(spark, folder):
    d = F.col("n_pairs") / F.nullif(F.col("n_users") * F.col("n_items"), F.lit(0))
    return _sizes(pairs(spark, folder)).withColumn("density", F.round(d, 8)).withColumn("sparsity", F.round(1 - d, 8))


_T = [2, 3, 5, 10]


@CORE.query("threshold_counts", f"WITH {PAIRS}, d AS (SELECT user_id, count(*) AS n FROM pairs GROUP BY 1) " + " UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (WHERE n >= {t}) AS n_users, round(100.0 * count(*) FILTER (WHERE n >= {t}) / count(*), 4) AS pct FROM d" for t in _T))
def threshold_counts(spark, folder):
    d = pairs(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    one = d.agg(F.count(F.lit(1)).alias("all"), *[F.count(F.when(F.col("n") >= t, 1)).alias(f"t{t}") for t in _T])
    e = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_users")) for t in _T]))
    return one.select("all", e.alias("e")).select("e.threshold", "e.n_users", F.round(100.0 * F.col("e.n_users") / F.col("all"), 4).alias("pct"))


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median, p90, p99 (linear interpolation) and max per ``by``. Percentiles run over the counts of distinct values."""
    g = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("w"))
    pct = lambda p: F.round(F.percentile(value, F.lit(p), F.col("w")), 6)
    return g.groupBy(by).agg(F.sum("w").alias("n"), F.round(F.sum(F.col(value) * F.col("w")) / F.sum("w"), 6).alias("mean"), pct(0.5).alias("median"), pct(0.9).alias("p90"), pct(0.99).alias("p99"), F.max(value).alias("max"))


@CORE.query("count_summary", f"WITH {PAIRS}, d AS (SELECT 'user' AS side, count(*) AS n FROM pairs GROUP BY user_id UNION ALL SELECT 'item', count(*) FROM pairs GROUP BY product_id) SELECT side, count(*) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max FROM d GROUP BY 1")
def count_summary(spark, folder):
    p = pairs(spark, folder)
    d = p.groupBy("user_id").agg(F.count(F.lit(1)).alias("v")).select(F.lit("user").alias("side"), "v").unionByName(p.groupBy("product_id").agg(F.count(F.lit(1)).alias("v")).select(F.lit("item").alias("side"), "v"))
    return summary(d, "side", "v")


@CORE.query("degrees", f"WITH {PAIRS} SELECT 'user' AS side, user_id AS id, count(*) AS degree FROM pairs GROUP BY user_id UNION ALL SELECT 'item', product_id, count(*) FROM pairs GROUP BY product_id")
def degrees(spark, folder):
    p = pairs(spark, folder)
    side = lambda s, c: p.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit(s).alias("side"), "id", "degree")
    return side("user", "user_id").unionByName(side("item", "product_id"))


@CORE.query("item_degree", f"WITH {SPLIT} SELECT product_id, count(*) AS degree FROM split WHERE split = 'train' GROUP BY 1")
def item_degree(spark, folder):
    return hist.leave_last(events(spark, folder)).where("split = 'train'").groupBy("product_id").agg(F.count(F.lit(1)).alias("degree"))


@CORE.query("value_distribution", "SELECT event_value AS value, count(*) AS n FROM interactions WHERE starts_with(event_type, 'review') AND NOT isnan(event_value) GROUP BY 1")
def value_distribution(spark, folder):
    return events(spark, folder).where(F.col("event_type").startswith("review") & F.col("event_value").isNotNull() & ~F.isnan("event_value")).groupBy(F.col("event_value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query("text_length_stats", "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.9), 6) AS p90, round(quantile_cont(length(text), 0.99), 6) AS p99, max(length(text)) AS max FROM documents WHERE text IS NOT NULL GROUP BY 1")
def text_length_stats(spark, folder):
    return summary(table(spark, folder, "documents").where("text IS NOT NULL").select("source", F.length("text").cast("bigint").alias("v")), "source", "v")


@CORE.query("having_distinct", "SELECT user_id, count(DISTINCT product_id) AS n_items FROM interactions GROUP BY 1 HAVING count(DISTINCT product_id) >= 3")
def having_distinct(spark, folder):
    return pairs(spark, folder).groupBy("user_id").agg(F.count("product_id").alias("n_items")).where("n_items >= 3")


@CORE.query("history_bins", f"WITH {PAIRS}, d AS (SELECT user_id, count(*) AS n FROM pairs GROUP BY 1) SELECT CASE WHEN n <= 1 THEN '<=1' WHEN n <= 4 THEN '2-4' ELSE '>=5' END AS bin, count(*) AS n_users FROM d GROUP BY 1")
def history_bins(spark, folder):
    d = pairs(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(hist.history_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("n_users"))


@CORE.query("nearest_rank_pct", """WITH s AS (SELECT request_id, channel, list_sort(list(score)) AS l FROM long GROUP BY 1, 2) SELECT request_id, channel, l[len(l) // 2 + 1] AS p50, l[round_even(0.95 * (len(l) - 1), 0)::INT + 1] AS p95 FROM s""".replace("WITH s", f"WITH {LONG}, s"))
def nearest_rank_pct(spark, folder):
    g = channels(spark, folder).groupBy("request_id", "channel").agg(F.array_sort(F.collect_list("score")).alias("l"))
    return g.select("request_id", "channel", F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("p50"), rk.nearest_rank(F.col("l"), 0.95).alias("p95"))


@CORE.query("mode_share", "WITH c AS (SELECT product_id, event_type, count(*) AS n FROM interactions GROUP BY 1, 2) SELECT product_id, event_type AS mode, round(n::DOUBLE / t, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY product_id) AS t, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1")
def mode_share(spark, folder):
    c = events(spark, folder).groupBy("product_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("product_id").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"))
    return g.select("product_id", F.col("b.event_type").alias("mode"), F.round(-F.col("b.m") / F.col("t"), 6).alias("share"))


@CORE.query("signal_coverage", f"WITH {LONG}, f AS (SELECT request_id, bool_or(channel = 'content') AS content, bool_or(channel = 'cf') AS cf FROM long GROUP BY 1), a AS (SELECT DISTINCT request_id FROM hybrid_candidates) SELECT count(*) FILTER (WHERE content AND cf) AS both, count(*) FILTER (WHERE content AND NOT cf) AS content_only, count(*) FILTER (WHERE cf AND NOT content) AS cf_only, count(*) FILTER (WHERE NOT coalesce(content, false) AND NOT coalesce(cf, false)) AS neither FROM a LEFT JOIN f USING (request_id)")
def signal_coverage(spark, folder):
    df = table(spark, folder, "hybrid_candidates")
    has = lambda c: F.max((F.col(f"{c}_present") & rk.finite(F.col(f"{c}_raw_score"))).cast("int")) == 1
    f = df.groupBy("request_id").agg(F.coalesce(has("content"), F.lit(False)).alias("a"), F.coalesce(has("cf"), F.lit(False)).alias("b"))
    n = lambda cond: F.count(F.when(cond, 1))
    a, b = F.col("a"), F.col("b")
    return f.agg(n(a & b).alias("both"), n(a & ~b).alias("content_only"), n(b & ~a).alias("cf_only"), n(~a & ~b).alias("neither"))


@CORE.query("rec_frequency", f"WITH {RANKED} SELECT product_id, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY 1")
def rec_frequency(spark, folder):
    return ranked_channels(spark, folder).where("rank <= 10").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("overlap_stats", f"WITH {RANKED}, u AS (SELECT request_id, product_id, bool_or(channel = 'content') AS a, bool_or(channel = 'cf') AS b FROM ranked WHERE channel IN ('content', 'cf') AND rank <= 10 GROUP BY 1, 2) SELECT request_id, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT b) AS left_only, count(*) FILTER (WHERE NOT a) AS right_only, round(count(*) FILTER (WHERE a AND b)::DOUBLE / count(*), 6) AS jaccard FROM u GROUP BY 1")
def overlap_stats(spark, folder):
    u = union_ranks(ranked_channels(spark, folder).where("rank <= 10"), CHANNELS[:2])
    a, b = F.col("content_rank").isNotNull(), F.col("cf_rank").isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    return u.groupBy("request_id").agg(n(a & b).alias("both"), n(~b).alias("left_only"), n(~a).alias("right_only"), F.round(n(a & b) / F.count(F.lit(1)), 6).alias("jaccard"))


@CORE.query("pair_checksum", f"WITH {PAIRS}, g AS (SELECT user_id, sha256(string_agg(user_id || chr(9) || product_id || chr(10), '' ORDER BY product_id)) AS h, count(*) AS n FROM pairs GROUP BY 1), b AS (SELECT substr(sha256(user_id), 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM g GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY h)) AS checksum FROM b")
def pair_checksum(spark, folder):
    """A checksum of the distinct pairs, digested per user, then per 256 groups of users, then once: no task holds all pairs."""
    line = F.concat("user_id", F.lit("\t"), "product_id", F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("product_id", line.alias("line")))), lambda x: x["line"])
    g = pairs(spark, folder).groupBy("user_id").agg(F.sha2(F.array_join(lines, ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    digest = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
    b = g.groupBy(F.substring(F.sha2("user_id", 256), 1, 2).alias("b")).agg(digest().alias("h"), F.sum("n").alias("n"))
    return b.agg(F.sum("n").alias("n"), digest().alias("checksum"))


# ---- windows


@CORE.query("rank_within_query", f"WITH {RANKED} SELECT request_id, channel, product_id, rank FROM ranked")
def rank_within_query(spark, folder):
    return ranked_channels(spark, folder).select("request_id", "channel", "product_id", "rank")


@CORE.query("stable_rank", f"WITH {RANKED} SELECT request_id, channel, product_id, score, rank FROM ranked WHERE rank <= 10")
def stable_rank(spark, folder):
    return rk.top_k(channels(spark, folder), ["request_id", "channel"], "score", "product_id", 10)


@CORE.query("topk_scores", f"WITH {RANKED} SELECT request_id, channel, product_id, score FROM ranked WHERE rank <= 5")
def topk_scores(spark, folder):
    return rk.top_k(channels(spark, folder), ["request_id", "channel"], "score", "product_id", 5).drop("rank")


@CORE.query("rank_of_hidden", f"WITH {RANKED}, h AS (SELECT request_id, max(product_id) AS hidden FROM hybrid_candidates GROUP BY 1) SELECT r.request_id, r.channel, h.hidden, max(r.rank) FILTER (WHERE r.product_id = h.hidden) AS rank FROM ranked r JOIN h USING (request_id) GROUP BY 1, 2, 3")
def rank_of_hidden(spark, folder):
    s = channels(spark, folder)
    h = table(spark, folder, "hybrid_candidates").groupBy("request_id").agg(F.max("product_id").alias("product_id")).join(s.select("request_id", "channel").distinct(), "request_id")
    return rk.hidden_rank(s, h, ["request_id", "channel"], "score", "product_id")


@CORE.query("leave_last_split", f"WITH {SPLIT} SELECT user_id, product_id, split FROM split")
def leave_last_split(spark, folder):
    return hist.leave_last(events(spark, folder)).select("user_id", "product_id", "split")


INNER = SPLIT + """, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, product_id DESC) AS r2, count(*) OVER (PARTITION BY user_id) AS c2 FROM split WHERE split = 'train'),
inner_split AS (SELECT user_id, product_id, CASE WHEN r2 = 1 AND c2 >= 2 THEN 'validation' ELSE 'train' END AS split FROM t)"""


@CORE.query("inner_tune_split", f"WITH {INNER} SELECT * FROM inner_split")
def inner_tune_split(spark, folder):
    return hist.inner_split(hist.leave_last(events(spark, folder))).select("user_id", "product_id", "split")


@CORE.query("history_unique", "SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY f, i) AS position FROM (SELECT user_id, product_id, min(occurred_at) AS f, arg_min(interaction_id, (occurred_at, interaction_id)) AS i FROM interactions GROUP BY 1, 2)")
def history_unique(spark, folder):
    return hist.first_seen_order(events(spark, folder))


@CORE.query("last_occurrence", "SELECT user_id, product_id, epoch_us(max(occurred_at)) AS last_us FROM interactions GROUP BY 1, 2")
def last_occurrence(spark, folder):
    return hist.last_seen(events(spark, folder)).select("user_id", "product_id", micros(F.col("occurred_at")).alias("last_us"))


@CORE.query("dedupe_first", "SELECT user_id, product_id, event_type, min(interaction_id) AS interaction_id FROM interactions GROUP BY 1, 2, 3")
def dedupe_first(spark, folder):
    """First row in input order of each (user, product, type), by aggregation rather than by a window."""
    return events(spark, folder).groupBy("user_id", "product_id", "event_type").agg(F.min("interaction_id").alias("interaction_id"))


@CORE.query("dedupe_exact", "SELECT DISTINCT user_id, product_id, event_type, epoch_us(occurred_at) AS us FROM interactions")
def dedupe_exact(spark, folder):
    return events(spark, folder).select("user_id", "product_id", "event_type", micros(F.col("occurred_at")).alias("us")).distinct()


@CORE.query("group_size_window", f"WITH {PAIRS} SELECT user_id, product_id, count(*) OVER (PARTITION BY user_id) AS user_items FROM pairs")
def group_size_window(spark, folder):
    return pairs(spark, folder).withColumn("user_items", F.count(F.lit(1)).over(W.partitionBy("user_id")))


@CORE.query("minmax_norm", f"WITH {LONG} SELECT request_id, channel, product_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM long WINDOW w AS (PARTITION BY request_id, channel)")
def minmax_norm(spark, folder):
    d = rk.with_minmax(channels(spark, folder), ["request_id", "channel"], "score")
    return d.select("request_id", "channel", "product_id", F.round("norm", 6).alias("norm"))


@CORE.query("rank_movement", f"""WITH {RANKED}, j AS (SELECT a.request_id, a.rank AS b, m.rank AS m FROM ranked a JOIN ranked m ON a.request_id = m.request_id AND a.product_id = m.product_id AND a.channel = 'content' AND m.channel = 'popularity')
SELECT request_id, round(avg(abs(b - m)), 6) AS mean_movement, max(abs(b - m)) AS max_movement, max(b - m) AS max_promotion, count(*) FILTER (WHERE b > m) AS improved, count(*) FILTER (WHERE b < m) AS worsened, count(*) FILTER (WHERE b <= 10 AND m <= 10) AS overlap10,
round(coalesce(count(*) FILTER (WHERE b <= 10 AND m <= 10)::DOUBLE / nullif(count(*) FILTER (WHERE b <= 10 OR m <= 10), 0), 0), 6) AS jaccard10 FROM j GROUP BY 1""")
def rank_movement(spark, folder):
    r = ranked_channels(spark, folder)
    d = rk.movement(r.where("channel = 'content'"), r.where("channel = 'popularity'"), ["request_id"], "product_id")
    return d.withColumn("mean_movement", F.round("mean_movement", 6)).withColumn("jaccard10", F.round("jaccard10", 6))


@CORE.query("array_dedupe", "SELECT user_id, list(event_type ORDER BY f) AS types FROM (SELECT user_id, event_type, min(interaction_id) AS f FROM interactions GROUP BY 1, 2) GROUP BY 1")
def array_dedupe(spark, folder):
    """Distinct event types of a user in the order of their first event."""
    firsts = events(spark, folder).groupBy("user_id", "event_type").agg(F.min("interaction_id").alias("f"))
    return firsts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]).alias("types"))


@CORE.query("recent_history", "SELECT user_id, interaction_id, rank FROM (SELECT user_id, interaction_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, interaction_id DESC) AS rank FROM interactions) WHERE rank <= 50")
def recent_history(spark, folder):
    """The 50 latest events of each user; tasks keep 50 per user before they shuffle."""
    order = W.partitionBy("user_id").orderBy(F.col("occurred_at").desc(), F.col("interaction_id").desc())
    return events(spark, folder).select("user_id", "interaction_id", "occurred_at").withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 50").select("user_id", "interaction_id", "rank")


_DEPTHS = [(10, None, 500), (30, None, 500), (100, None, 500), (1, None, 500), (80, None, 200), (10, 250, 500), (80, 40, 500)]


@CORE.query("candidate_depth", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if c is None else c}, {m}, {rk.candidate_depth(k, c, m)})" for k, c, m in _DEPTHS) + ") v(top_k, configured, maximum, depth)")
def candidate_depth(spark, folder):
    d = spark.createDataFrame(_DEPTHS, "top_k int, configured int, maximum int")
    wanted = F.greatest("top_k", F.coalesce("configured", F.greatest(F.lit(100), F.col("top_k") * 5)))
    return d.withColumn("depth", F.least("maximum", wanted))


# ---- sets


def _set_sql(op: str) -> str:
    return f"SELECT product_id FROM products {op} SELECT product_id FROM interactions"


@CORE.query("setop_union", _set_sql("UNION"))
def setop_union(spark, folder):
    return products(spark, folder).select("product_id").union(events(spark, folder).select("product_id")).distinct()


@CORE.query("setop_intersect", _set_sql("INTERSECT"))
def setop_intersect(spark, folder):
    return products(spark, folder).select("product_id").intersect(events(spark, folder).select("product_id"))


@CORE.query("setop_except", _set_sql("EXCEPT"))
def setop_except(spark, folder):
    return products(spark, folder).select("product_id").subtract(events(spark, folder).select("product_id"))


@CORE.query("leakage_check", f"WITH {INNER}, s AS (SELECT user_id, product_id FROM split WHERE split = 'test') SELECT (SELECT count(*) FROM inner_split i JOIN s USING (user_id, product_id)) AS test_in_train, (SELECT count(*) FROM inner_split a JOIN inner_split b ON a.user_id = b.user_id AND a.product_id = b.product_id AND a.split = 'train' AND b.split = 'validation') AS validation_in_train")
def leakage_check(spark, folder):
    """Both counts are 0 if no hidden pair leaks."""
    split = hist.leave_last(events(spark, folder))
    inner, key = hist.inner_split(split), ["user_id", "product_id"]
    a = inner.join(split.where("split = 'test'").select(*key), key, "left_semi").agg(F.count(F.lit(1)).alias("test_in_train"))
    b = inner.where("split = 'train'").join(inner.where("split = 'validation'").select(*key), key, "left_semi").agg(F.count(F.lit(1)).alias("validation_in_train"))
    return a.crossJoin(F.broadcast(b))


@CORE.query("identity_check", "SELECT 0::BIGINT AS only_before, 0::BIGINT AS only_after")
def identity_check(spark, folder):
    """A ranking is a permutation of its candidates: both differences are empty."""
    before, after = channels(spark, folder).select("request_id", "channel", "product_id"), ranked_channels(spark, folder).select("request_id", "channel", "product_id")
    return before.exceptAll(after).agg(F.count(F.lit(1)).alias("only_before")).crossJoin(F.broadcast(after.exceptAll(before).agg(F.count(F.lit(1)).alias("only_after"))))


@CORE.query("unique_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def unique_pairs(spark, folder):
    return pairs(spark, folder)


@CORE.query("positive_sets", f"WITH {SPLIT} SELECT user_id, list(product_id ORDER BY product_id) AS items FROM split WHERE split = 'train' GROUP BY 1")
def positive_sets(spark, folder):
    return hist.leave_last(events(spark, folder)).where("split = 'train'").groupBy("user_id").agg(F.array_sort(F.collect_list("product_id")).alias("items"))
