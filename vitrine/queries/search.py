"""Text features, keyword and vector retrieval, fusion and hybrid search.

The stated query set of the searches: every vector whose row_no is divisible by 50, with the title query of its product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as tx
from vitrine.operators import fusion as fu
from vitrine.operators import keyword as kw
from vitrine.operators import ranking as rk
from vitrine.operators import vectors as ve
from vitrine.plans.storage import materialize
from vitrine.queries import CORE
from vitrine.queries.ingest import collapse_sql, strip_sql  # noqa: F401
from vitrine.queries.relational import CHANNELS, LONG, RANKED, channels, ranked_channels
from vitrine.sources.tables import table

_QUIET = "(" + ", ".join(f"'{w}'" for w in tx.QUIET_WORDS) + ")"
_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


def casefold_sql(c: str) -> str:
    """Lower case with the expansions that yield ASCII letters."""
    out = f"lower({c})"
    for letter, several in (("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        out = f"replace({out}, '{letter}', '{several}')"
    return out


def tokens_sql(c: str) -> str:
    return f"coalesce(regexp_extract_all({casefold_sql(c)}, '[0-9a-z]+'), [])"


def stem_sql(t: str) -> str:
    return f"""CASE WHEN regexp_matches({t}, 'ies$') AND NOT regexp_matches({t}, '(eies|aies)$') THEN regexp_replace({t}, 'ies$', 'y')
WHEN regexp_matches({t}, 'es$') AND NOT regexp_matches({t}, '(aes|ees|oes)$') THEN regexp_replace({t}, 'es$', 'e')
WHEN regexp_matches({t}, 's$') AND NOT regexp_matches({t}, '(us|ss)$') THEN regexp_replace({t}, 's$', '') ELSE {t} END"""


def terms_sql(c: str) -> str:
    return f"list_transform(list_filter({tokens_sql(c)}, lambda t: t NOT IN {_STOP}), lambda t: {stem_sql('t')})"


def informative_sql(c: str) -> str:
    """Distinct tokens in the order of their first occurrence."""
    f = f"list_filter({tokens_sql(c)}, lambda t: length(t) >= 2 AND NOT regexp_matches(t, '[0-9]') AND t NOT IN {_QUIET})"
    return f"(SELECT coalesce(list(w ORDER BY p), []) FROM (SELECT w, min(p) AS p FROM (SELECT unnest({f}) AS w, unnest(range(len({f}))) AS p) GROUP BY w))"


def title_query_sql(c: str) -> str:
    return f"(SELECT CASE WHEN len(i) >= 2 THEN i[-2] || ' ' || i[-1] END FROM (SELECT {informative_sql(c)} AS i))"


PRODUCT_TEXT = ["title", "brand", "description", "category", "subcategory"]


@CORE.query("tokenize", f"SELECT product_id, {tokens_sql('title')} AS tokens FROM products")
def tokenize(spark, folder):
    return table(spark, folder, "products").select("product_id", tx.tokens(F.col("title")).alias("tokens"))


@CORE.query("normalize_phrase", f"SELECT search_event_id, {collapse_sql(casefold_sql('query_text'))} AS phrase FROM search_events")
def normalize_phrase(spark, folder):
    return table(spark, folder, "search_events").select("search_event_id", tx.phrase(F.col("query_text")).alias("phrase"))


@CORE.query(
    "text_overlap",
    f"""SELECT search_event_id, len(list_intersect(list_distinct(q), list_distinct(t))) AS overlap, round(coalesce(len(list_intersect(list_distinct(q), list_distinct(t)))::DOUBLE / nullif(len(list_distinct(q)), 0), 0), 6) AS ratio,
coalesce(len(list_distinct(q)) > 0 AND len(list_intersect(list_distinct(q), list_distinct(t))) = len(list_distinct(q)), false) AS all_present, coalesce(contains({collapse_sql('lower(title)')}, {collapse_sql('lower(query_text)')}), false) AS exact_phrase
FROM (SELECT search_event_id, query_text, title, {tokens_sql('query_text')} AS q, {tokens_sql('title')} AS t FROM search_events JOIN products ON product_id = clicked_product_id)""",
)
def text_overlap(spark, folder):
    """Overlap of each query with the title of the product that was clicked."""
    p = table(spark, folder, "products").select(F.col("product_id").alias("clicked_product_id"), "title")
    d = table(spark, folder, "search_events").join(p, "clicked_product_id")
    q, t = tx.tokens(F.col("query_text")), tx.tokens(F.col("title"))
    n = F.size(F.array_distinct(q))
    return d.select("search_event_id", tx.overlap_count(q, t).cast("bigint").alias("overlap"), F.round(tx.overlap_ratio(q, t), 6).alias("ratio"), ((n > 0) & (tx.overlap_count(q, t) == n)).alias("all_present"), F.coalesce(F.contains(tx.phrase(F.col("title")), tx.phrase(F.col("query_text"))), F.lit(False)).alias("exact_phrase"))


@CORE.query("synth_title_query", f"SELECT product_id, {title_query_sql('title')} AS query FROM products")
def synth_title_query(spark, folder):
    return table(spark, folder, "products").select("product_id", tx.title_query(F.col("title")).alias("query"))


@CORE.query(
    "synth_attr_query",
    f"""WITH s AS (SELECT product_id, {tokens_sql('brand')} AS b, {informative_sql('title')} AS i, {title_query_sql('title')} AS tq FROM products),
r AS (SELECT product_id, b, tq, list_filter(i, lambda x: NOT list_contains(b, x)) AS rest FROM s), q AS (SELECT product_id, tq, CASE WHEN len(b) > 0 AND len(rest) > 0 THEN b[1] || ' ' || rest[-1] END AS q FROM r)
SELECT product_id, CASE WHEN q IS DISTINCT FROM tq THEN q END AS query FROM q""",
)
def synth_attr_query(spark, folder):
    return table(spark, folder, "products").select("product_id", tx.attribute_query(F.col("title"), F.col("brand")).alias("query"))


@CORE.query("query_ids", "SELECT search_event_id, substr(sha256(concat_ws(chr(10), coalesce(user_id, ''), coalesce(query_text, ''))), 1, 16) AS query_id FROM search_events")
def query_ids(spark, folder):
    return table(spark, folder, "search_events").select("search_event_id", tx.stable_id(F.coalesce("user_id", F.lit("")), F.coalesce("query_text", F.lit(""))).alias("query_id"))


@CORE.query(
    "prepare_queries",
    f"""SELECT search_event_id, target, CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing_title' WHEN {title_query_sql('title')} IS NULL THEN 'blank_synthetic_query' END AS skip_reason, {title_query_sql('title')} AS query
FROM (SELECT search_event_id, converted_product_id AS target, title FROM search_events LEFT JOIN products ON product_id = converted_product_id WHERE converted_product_id IS NOT NULL)""",
)
def prepare_queries(spark, folder):
    """Queries made from held-out targets (the converted products), with the reason where none can be made."""
    p = table(spark, folder, "products").select(F.col("product_id").alias("target"), "title")
    s = table(spark, folder, "search_events").where(F.col("converted_product_id").isNotNull()).select("search_event_id", F.col("converted_product_id").alias("target"))
    q = tx.title_query(F.col("title"))
    reason = F.when(F.col("title").isNull() | (F.trim("title") == ""), "missing_title").when(q.isNull(), "blank_synthetic_query")
    return s.join(p, "target", "left").select("search_event_id", "target", reason.alias("skip_reason"), q.alias("query"))


# ---- keyword search

_PARTS = " UNION ALL ".join(f"SELECT product_id, {i} AS f, '{kw.FIELDS[c]}' AS class, {terms_sql(c)} AS t FROM products" for i, c in enumerate(kw.FIELDS))
POST = f"part_terms AS ({_PARTS}), post AS (SELECT product_id, class, unnest(t) AS term FROM part_terms)"
WEIGHT = "weight AS (SELECT term, product_id, sum(CASE class WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END) AS w FROM post GROUP BY 1, 2)"
QUERY_SET = f"""valid AS (SELECT row_no, product_id, embedding FROM product_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT row_no, product_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM valid),
qset AS (SELECT u.row_no AS query_id, u.product_id AS source, u.v, {title_query_sql('p.title')} AS query FROM unit u JOIN products p USING (product_id) WHERE u.row_no % 50 = 0)"""
KEYWORD = "qterm AS (SELECT query_id, unnest(t) AS term, len(t) AS n_terms FROM (SELECT query_id, list_distinct(" + terms_sql("query") + ") AS t FROM qset)), kwhit AS (SELECT query_id, product_id, round(sum(w / (w + 1)), 6) AS score FROM qterm JOIN weight USING (term) GROUP BY query_id, product_id, n_terms HAVING count(*) = n_terms), kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM kwhit)"
SEMANTIC = "sem AS (SELECT q.query_id, u.product_id, round(list_dot_product(q.v, u.v), 9) AS score FROM qset q, unit u), semr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM sem)"
HYBRID = f"{QUERY_SET}, {POST}, {WEIGHT}, {KEYWORD}, {SEMANTIC}, ch AS (SELECT query_id, product_id, 'keyword' AS channel, score, rank FROM kwr WHERE rank <= 100 UNION ALL SELECT query_id, product_id, 'semantic', score, rank FROM semr WHERE rank <= 100)"


def unit_vectors(spark, folder) -> DataFrame:
    """row_no, product_id, v of the usable vectors, as unit vectors."""
    d = table(spark, folder, "product_vectors").where(ve.usable(F.col("embedding")))
    return d.select("row_no", "product_id", ve.unit(F.col("embedding")).alias("v"))


def query_set(spark, folder) -> DataFrame:
    """query_id, source, v, query."""
    q = unit_vectors(spark, folder).where("row_no % 50 = 0")
    p = table(spark, folder, "products").select("product_id", tx.title_query(F.col("title")).alias("query"))
    return q.join(p, "product_id").select(F.col("row_no").alias("query_id"), F.col("product_id").alias("source"), "v", "query")


def product_postings(spark, folder) -> DataFrame:
    return kw.postings(table(spark, folder, "products").select("product_id", *PRODUCT_TEXT))


def keyword_ranked(spark, folder) -> DataFrame:
    hits = kw.match_all(kw.query_terms(query_set(spark, folder), "query_id", "query"), product_postings(spark, folder), "query_id")
    return rk.ranked(hits, ["query_id"], "score", "product_id")


def semantic_ranked(spark, folder, k: int = 100) -> DataFrame:
    return ve.exact_top_k(query_set(spark, folder).select("query_id", "v"), unit_vectors(spark, folder).select("product_id", "v"), k)


def search_channels(spark, folder, depth: int = 100) -> DataFrame:
    """query_id, product_id, channel, score, rank of keyword and semantic retrieval to the given depth, written once for its readers."""
    k = keyword_ranked(spark, folder).where(F.col("rank") <= depth).withColumn("channel", F.lit("keyword"))
    return materialize(k.unionByName(semantic_ranked(spark, folder, depth).withColumn("channel", F.lit("semantic"))), "channels")


@CORE.query("fts_postings", f"WITH {POST} SELECT term, product_id, class, count(*) AS tf FROM post GROUP BY ALL")
def fts_postings(spark, folder):
    return product_postings(spark, folder).select("term", "product_id", "class", "tf")


@CORE.query("keyword_match", f"WITH {QUERY_SET}, {POST}, {WEIGHT}, {KEYWORD} SELECT query_id, product_id FROM kwhit")
def keyword_match(spark, folder):
    return keyword_ranked(spark, folder).select("query_id", "product_id")


@CORE.query("keyword_topk", f"WITH {QUERY_SET}, {POST}, {WEIGHT}, {KEYWORD} SELECT query_id, product_id, score, rank FROM kwr WHERE rank <= 10")
def keyword_topk(spark, folder):
    return keyword_ranked(spark, folder).where("rank <= 10")


@CORE.query("keyword_search", f"WITH {QUERY_SET}, {POST}, {WEIGHT}, {KEYWORD} SELECT query_id, rank, p.product_id, p.title, p.price FROM kwr JOIN products p USING (product_id) WHERE rank <= 10")
def keyword_search(spark, folder):
    p = table(spark, folder, "products").select("product_id", "title", "price")
    return keyword_ranked(spark, folder).where("rank <= 10").join(p, "product_id").select("query_id", "rank", "product_id", "title", "price")


@CORE.query("keyword_stopword", "SELECT NULL::BIGINT AS query_id, NULL::VARCHAR AS product_id, NULL::DOUBLE AS score WHERE false")
def keyword_stopword(spark, folder):
    """Queries of stop words only find nothing and are no error."""
    q = spark.createDataFrame([(1, "the of and"), (2, ""), (3, None)], "query_id bigint, query string")
    return kw.match_all(kw.query_terms(q, "query_id", "query"), product_postings(spark, folder), "query_id")


@CORE.query("keyword_cover")
def keyword_cover(spark, folder):
    """Cover-density ranking from positions."""
    hits = kw.cover_density(kw.query_terms(query_set(spark, folder), "query_id", "query"), product_postings(spark, folder), "query_id")
    return rk.ranked(hits, ["query_id"], "score", "product_id").where("rank <= 10")


@CORE.query("websearch_parse")
def websearch_parse(spark, folder):
    """The distinct search texts parsed to alternatives, phrases and exclusions."""
    def parse(batches):
        import json

        from vitrine.functions.text import parse_web_query

        for b in batches:
            q = [parse_web_query(t) for t in b.query_text]
            yield b.assign(groups=[json.dumps(x.groups) for x in q], without=[json.dumps(x.without) for x in q])

    return table(spark, folder, "search_events").select("query_text").distinct().mapInPandas(parse, "query_text string, groups string, without string")


# ---- vectors


@CORE.query("l2_normalize", f"WITH {QUERY_SET} SELECT row_no, product_id, list_transform(v, lambda x: round(x, 6) + 0.0) AS v FROM unit")
def l2_normalize(spark, folder):
    return unit_vectors(spark, folder).select("row_no", "product_id", F.transform("v", lambda x: F.round(x, 6) + F.lit(0.0)).alias("v"))


@CORE.query("unit_norm_check", f"WITH {QUERY_SET} SELECT row_no, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) - 1) <= 0.001 AS is_unit FROM valid")
def unit_norm_check(spark, folder):
    d = table(spark, folder, "product_vectors").where(ve.usable(F.col("embedding")))
    n = ve.norm(F.col("embedding"))
    return d.select("row_no", F.round(n, 6).alias("norm"), (F.abs(n - 1) <= 0.001).alias("is_unit"))


@CORE.query("index_validate", """SELECT count(*) AS n_rows, count(DISTINCT product_id) AS n_ids, count(*) FILTER (WHERE embedding IS NULL) AS n_null, count(*) FILTER (WHERE len(embedding) <> 64) AS n_wrong_size,
count(*) FILTER (WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS n_not_finite FROM product_vectors""")
def index_validate(spark, folder):
    e = F.col("embedding")
    bad = F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, folder, "product_vectors").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("product_id").alias("n_ids"), n(e.isNull()).alias("n_null"), n(F.size(e) != 64).alias("n_wrong_size"), n(bad).alias("n_not_finite"))


@CORE.query("knn_exact", f"WITH {QUERY_SET}, {SEMANTIC} SELECT query_id, product_id, rank, score FROM semr WHERE rank <= 10")
def knn_exact(spark, folder):
    d = semantic_ranked(spark, folder, 10)
    return d.select("query_id", "product_id", "rank", "score")


@CORE.query("similar_items", f"WITH {QUERY_SET}, {SEMANTIC}, o AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.product_id) AS r FROM sem s JOIN qset q USING (query_id) WHERE s.product_id <> q.source) SELECT query_id, o.product_id, p.title, r AS rank FROM o JOIN products p USING (product_id) WHERE r <= 10")
def similar_items(spark, folder):
    """Neighbours of stored vectors without the source itself, with titles."""
    near = semantic_ranked(spark, folder, 11).join(query_set(spark, folder).select("query_id", F.col("source").alias("product_id")), ["query_id", "product_id"], "left_anti")
    top = rk.ranked(near.drop("rank"), ["query_id"], "score", "product_id").where("rank <= 10")
    return top.join(table(spark, folder, "products").select("product_id", "title"), "product_id").select("query_id", "product_id", "title", "rank")


@CORE.query("knn_excluding", f"WITH {QUERY_SET}, {SEMANTIC}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS r FROM sem WHERE product_id NOT IN (SELECT product_id FROM products WHERE removed_at IS NOT NULL)) SELECT query_id, product_id, r AS rank FROM o WHERE r <= 10")
def knn_excluding(spark, folder):
    """Neighbours among listings that are not removed: excluded before top-k, so nothing is fetched again."""
    gone = table(spark, folder, "products").where("removed_at IS NOT NULL").select("product_id")
    items = unit_vectors(spark, folder).select("product_id", "v").join(gone, "product_id", "left_anti")
    return ve.exact_top_k(query_set(spark, folder).select("query_id", "v"), items, 10).select("query_id", "product_id", "rank")


_PLANES = [ve.planes(6, 64, 100 + t) for t in range(4)]


def _bucket_sql(v: str, normals) -> str:
    return " + ".join(f"(CASE WHEN list_dot_product({v}, {p}::DOUBLE[]) >= 0 THEN {1 << i} ELSE 0 END)" for i, p in enumerate(normals))


_LSH = ", ".join(f"h{t} AS (SELECT product_id, v, {_bucket_sql('v', p)} AS b FROM unit), q{t} AS (SELECT query_id, v, {_bucket_sql('v', p)} AS b FROM qset)" for t, p in enumerate(_PLANES))
LSH = _LSH + ", met AS (" + " UNION ".join(f"SELECT q{t}.query_id, h{t}.product_id, round(list_dot_product(q{t}.v, h{t}.v), 9) AS score FROM q{t} JOIN h{t} USING (b)" for t in range(4)) + "), lshr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM met)"


#: Buckets of a table, of its 64, that the probed queries look into.
PROBES = 16


def lsh_ranked(spark, folder, k: int = 10, probes: int = 1) -> DataFrame:
    return ve.lsh_top_k(query_set(spark, folder).select("query_id", "v"), unit_vectors(spark, folder).select("product_id", "v"), k, _PLANES, probes=probes)


@CORE.query("knn_lsh", f"WITH {QUERY_SET}, {LSH} SELECT query_id, product_id, rank FROM lshr WHERE rank <= 10")
def knn_lsh(spark, folder):
    return lsh_ranked(spark, folder).select("query_id", "product_id", "rank")


@CORE.query("ann_recall", f"WITH {QUERY_SET}, {SEMANTIC}, {LSH} SELECT s.query_id, round(count(l.product_id) / 10.0, 6) AS recall FROM semr s LEFT JOIN (SELECT * FROM lshr WHERE rank <= 10) l ON l.query_id = s.query_id AND l.product_id = s.product_id WHERE s.rank <= 10 GROUP BY 1")
def ann_recall(spark, folder):
    d = ve.recall(lsh_ranked(spark, folder), semantic_ranked(spark, folder, 10), 10)
    return d.select("query_id", F.round("recall", 6).alias("recall"))


@CORE.query("knn_probed")
def knn_probed(spark, folder):
    """knn_lsh over the nearest buckets of each table, not the query's own alone."""
    return lsh_ranked(spark, folder, probes=PROBES).select("query_id", "product_id", "rank")


@CORE.query("ann_probed_recall")
def ann_probed_recall(spark, folder):
    d = ve.recall(lsh_ranked(spark, folder, probes=PROBES), semantic_ranked(spark, folder, 10), 10)
    return d.select("query_id", F.round("recall", 6).alias("recall"))


def ivf_ranked(spark, folder, k: int = 10) -> DataFrame:
    return ve.ivf_top_k(query_set(spark, folder).select("query_id", "v"), unit_vectors(spark, folder).select("product_id", "v"), k)


@CORE.query("knn_ivf")
def knn_ivf(spark, folder):
    """The ten nearest items of each query by an inverted file; its recall is ann_ivf_recall."""
    return ivf_ranked(spark, folder).select("query_id", "product_id", "rank")


@CORE.query("ann_ivf_recall")
def ann_ivf_recall(spark, folder):
    d = ve.recall(ivf_ranked(spark, folder), semantic_ranked(spark, folder, 10), 10)
    return d.select("query_id", F.round("recall", 6).alias("recall"))


@CORE.query("encode_hash")
def encode_hash(spark, folder):
    """Titles encoded by the hashing encoder."""
    from vitrine.functions.encoder import hashed_vector

    return table(spark, folder, "products").select("product_id", hashed_vector(tx.terms(F.col("title"))).alias("v"))


# ---- fusion


@CORE.query("fuse_rrf", f"WITH {RANKED}, f AS (SELECT request_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranked WHERE channel IN ('content', 'cf') GROUP BY 1, 2) SELECT request_id, product_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS rank FROM f")
def fuse_rrf(spark, folder):
    return fu.rrf(ranked_channels(spark, folder).where(F.col("channel").isin("content", "cf")), "request_id", "product_id")


def weighted_sql(weights: dict[str, float], source: str = "long", query: str = "request_id", renormalise: bool = True) -> str:
    names = ", ".join(f"'{c}'" for c in weights)
    w = "CASE channel " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in weights.items()) + " END"
    total = "sum(w) OVER (PARTITION BY q)" if renormalise else "1"
    return f"""wb AS (SELECT {query} AS q, channel, min(score) AS lo, max(score) AS hi, max({w}) AS w FROM {source} WHERE channel IN ({names}) GROUP BY 1, 2), wt AS (SELECT *, {total} AS t FROM wb),
wf AS (SELECT l.{query}, l.product_id, round(sum((CASE WHEN hi = lo THEN 1.0 ELSE (l.score - lo) / (hi - lo) END) * w / t), 9) AS score FROM {source} l JOIN wt ON wt.q = l.{query} AND wt.channel = l.channel WHERE t > 0 GROUP BY 1, 2),
wr AS (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, product_id) AS rank FROM wf)"""


@CORE.query("fuse_weighted", f"WITH {LONG}, {weighted_sql({'content': 0.5, 'cf': 0.5}, renormalise=False)} SELECT request_id, product_id, score, rank FROM wr")
def fuse_weighted(spark, folder):
    return fu.weighted(channels(spark, folder), "request_id", "product_id", {"content": 0.5, "cf": 0.5}, renormalise=False)


@CORE.query("rec_fuse_rrf", f"WITH {RANKED}, f AS (SELECT request_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranked GROUP BY 1, 2) SELECT request_id, product_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS rank FROM f")
def rec_fuse_rrf(spark, folder):
    return fu.rrf(ranked_channels(spark, folder), "request_id", "product_id").select("request_id", "product_id", "rank")


REC_WEIGHTS = {"content": 0.6, "cf": 0.3, "popularity": 0.1}


@CORE.query("rec_fuse_weighted", f"WITH {LONG}, {weighted_sql(REC_WEIGHTS)} SELECT request_id, product_id, score, rank FROM wr")
def rec_fuse_weighted(spark, folder):
    return fu.weighted(channels(spark, folder), "request_id", "product_id", fu.check_weights(REC_WEIGHTS))


_REASONS = "CASE WHEN content AND cf THEN NULL WHEN content THEN 'cf_user_unavailable' WHEN cf THEN 'no_usable_content_history' WHEN popularity THEN 'popularity_only' ELSE 'no_channel' END"


@CORE.query("channel_fallback", f"WITH {LONG}, a AS (SELECT request_id, coalesce(bool_or(channel = 'content'), false) AS content, coalesce(bool_or(channel = 'cf'), false) AS cf, coalesce(bool_or(channel = 'popularity'), false) AS popularity FROM (SELECT DISTINCT request_id FROM hybrid_candidates) LEFT JOIN long USING (request_id) GROUP BY 1) SELECT *, {_REASONS} AS reason FROM a")
def channel_fallback(spark, folder):
    """Available channels of each request and the reason of a degraded list."""
    df = table(spark, folder, "hybrid_candidates")
    has = lambda c: F.coalesce(F.max((F.col(f"{c}_present") & rk.finite(F.col(f"{c}_raw_score"))).cast("int")) == 1, F.lit(False)).alias(c)
    a = df.groupBy("request_id").agg(*[has(c) for c in CHANNELS])
    return a.withColumn("reason", fu.fallback_reason(*[F.col(c) for c in CHANNELS]))


@CORE.query("hybrid_search_rrf", f"WITH {HYBRID}, f AS (SELECT query_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ch GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM f) SELECT query_id, rank, p.product_id, p.title FROM r JOIN products p USING (product_id) WHERE rank <= 10")
def hybrid_search_rrf(spark, folder):
    top = fu.rrf(search_channels(spark, folder), "query_id", "product_id").where("rank <= 10")
    return top.join(table(spark, folder, "products").select("product_id", "title"), "product_id").select("query_id", "rank", "product_id", "title")


@CORE.query("hybrid_search_weighted", f"WITH {HYBRID}, {weighted_sql({'keyword': 0.5, 'semantic': 0.5}, 'ch', 'query_id', False)} SELECT query_id, rank, product_id, score FROM wr WHERE rank <= 10")
def hybrid_search_weighted(spark, folder):
    d = fu.weighted(search_channels(spark, folder), "query_id", "product_id", {"keyword": 0.5, "semantic": 0.5}, renormalise=False).where("rank <= 10")
    return d.select("query_id", "rank", "product_id", "score")


@CORE.query("self_retrieval", f"WITH {QUERY_SET}, {POST}, {WEIGHT}, {KEYWORD} SELECT count(*) AS n_queries, count(*) FILTER (WHERE rank <= 10) AS hits FROM qset q LEFT JOIN kwr k ON k.query_id = q.query_id AND k.product_id = q.source")
def self_retrieval(spark, folder):
    """How many queries find the product whose title they come from in the first ten."""
    q = query_set(spark, folder).select("query_id", F.col("source").alias("product_id"))
    j = q.join(keyword_ranked(spark, folder), ["query_id", "product_id"], "left")
    return j.agg(F.count(F.lit(1)).alias("n_queries"), F.count(F.when(F.col("rank") <= 10, 1)).alias("hits"))


def _alpha_sql(a: float) -> str:
    return f"SELECT {a} AS alpha, count(*) AS n_queries, count(*) FILTER (WHERE r.rank <= 10) AS hits FROM qset q LEFT JOIN (WITH {weighted_sql({'keyword': a, 'semantic': 1 - a}, 'ch', 'query_id', False)} SELECT * FROM wr) r ON r.query_id = q.query_id AND r.product_id = q.source"


@CORE.query("alpha_sweep", f"WITH {HYBRID} " + " UNION ALL ".join(_alpha_sql(a) for a in (0.25, 0.5, 0.75)))
def alpha_sweep(spark, folder):
    """Title self-retrieval for three weights of the keyword channel, over one candidate set."""
    ch = search_channels(spark, folder)
    q = query_set(spark, folder).select("query_id", F.col("source").alias("product_id"))
    one = lambda a: q.join(fu.weighted(ch, "query_id", "product_id", {"keyword": a, "semantic": 1 - a}, renormalise=False), ["query_id", "product_id"], "left").agg(F.count(F.lit(1)).alias("n_queries"), F.count(F.when(F.col("rank") <= 10, 1)).alias("hits")).select(F.lit(a).alias("alpha"), "n_queries", "hits")
    return reduce(DataFrame.unionByName, [one(a) for a in (0.25, 0.5, 0.75)])
