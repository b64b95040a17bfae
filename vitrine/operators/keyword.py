"""Keyword search over an inverted index: postings with field weights, conjunctive matching, scores and cover density."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import terms

#: Weights of the field classes: A title and brand, B description, C category and subcategory.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
SALTS = 16
#: Beyond the number of terms that a text can have.
FIELD = 1 << 32
FIELDS = {"title": "A", "brand": "A", "description": "B", "category": "C", "subcategory": "C"}


def postings(products: DataFrame, item: str = "product_id") -> DataFrame:
    """term, item, field class, tf, positions: one row per term, item and class. Position counts from 0 through the fields in order."""
    parts = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(c).alias("class"), terms(F.col(f)).alias("t")) for i, (f, c) in enumerate(FIELDS.items())])
    rows = products.select(F.col(item), F.explode(parts).alias("p")).select(item, "p.f", "p.class", F.posexplode("p.t").alias("pos", "term"))
    return rows.groupBy("term", item, "class").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list(F.struct("f", "pos"))).alias("positions"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, term, n_terms: distinct terms of each query. A query of stop words only has no row, so it finds nothing."""
    t = F.array_distinct(terms(F.col(text)))
    return queries.select(query, t.alias("t")).select(query, F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def _meet(queries: DataFrame, postings: DataFrame, item: str) -> DataFrame:
    """The queries' terms joined with their postings. A common term has as many postings as there are items: they are spread over SALTS parts
    by item, and the terms, few in comparison, go to each part."""
    parts = postings.withColumn("_s", F.pmod(F.xxhash64(item), F.lit(SALTS)).cast("int"))
    return queries.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(parts, ["term", "_s"]).drop("_s")


def match_all(queries: DataFrame, index: DataFrame, query: str, item: str = "product_id") -> DataFrame:
    """query, item, score of the items that hold all terms of the query. A term adds w / (w + 1), w being the weighted count of its
    occurrences. Postings are first added up per term and item; the salted equi-join on the term is the only thing that meets them."""
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    w = index.groupBy("term", item).agg(F.sum(F.col("tf") * weight[F.col("class")]).alias("w"))
    hits = _meet(queries, w, item)
    return hits.groupBy(query, item, "n_terms").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w") / (F.col("w") + 1)), 6).alias("score")).where("n = n_terms").select(query, item, "score")


def cover_density(queries: DataFrame, index: DataFrame, query: str, item: str = "product_id") -> DataFrame:
    """query, item, score: the sum over minimal covers (spans that hold all query terms and no smaller such span) of the inverse of their
    length (Clarke, Cormack and Tudhope 1999), for items that hold all terms. Positions of different fields lie further
    apart than any field is long."""
    flat = index.groupBy("term", item).agg(F.flatten(F.collect_list(F.transform("positions", lambda p: p["f"].cast("bigint") * FIELD + p["pos"]))).alias("at"))
    hits = _meet(queries, flat, item).groupBy(query, item, "n_terms").agg(F.collect_list("at").alias("at"), F.count(F.lit(1)).alias("n")).where("n = n_terms").select(query, item, "at")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=[_covers([list(x) for x in at]) for at in b["at"]])[[query, item, "score"]]

    q, i = hits.schema[query], hits.schema[item]
    return hits.mapInPandas(score, f"{query} {q.dataType.simpleString()}, {item} {i.dataType.simpleString()}, score double")


def _covers(at: list[list[int]]) -> float:
    """Sweeps all positions in order; a span is a cover when every term has been seen, minimal when its first term recurs only later."""
    events = sorted((p, t) for t, ps in enumerate(at) for p in ps)
    last: dict[int, int] = {}
    total, before = 0.0, -1
    for p, t in events:
        last[t] = p
        if len(last) == len(at):
            start = min(last.values())
            if start > before:
                total += 1.0 / (p - start + 1)
                before = start
    return total
