"""Ranks of hidden items, made in the tasks, against the lists themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import blocks as bl
from vitrine.operators import fusion as fu
from vitrine.operators import recommend as rec
from vitrine.operators import vectors as ve

WEIGHTS = {"content": 0.6, "cf": 0.3, "popularity": 0.1}


@pytest.fixture(scope="module")
def tables(spark):
    """40 items, the last 8 without a vector, five with the same; 30 users, of whom one has seen nearly all and some only items without vectors."""
    rng = np.random.default_rng(8)
    ids, users = [f"p{i:02}" for i in range(40)], [f"u{i:02}" for i in range(30)]
    v = rng.standard_normal((32, 64))
    v[3:8] = v[3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    had = {u: rng.choice(40, rng.integers(2, 9), replace=False) for u in users} | {"u00": rng.permutation(40)[:38], "u01": np.array([33, 5]), "u02": np.array([33, 39])}
    train = spark.createDataFrame([(u, ids[i]) for u, x in had.items() for i in x[:-1]] + [("u05", None)], "user_id string, product_id string")
    hidden = spark.createDataFrame([(u, ids[x[-1]]) for u, x in had.items() if u != "u03"] + [("u03", None)], "user_id string, product_id string")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "product_id string, v array<double>")
    counts = spark.createDataFrame([(i, int(n)) for i, n in zip(ids, rng.integers(1, 6, 40)) if i != "p11"] + [(None, 9)], "product_id string, n bigint")
    return train, hidden, vectors, counts


def listed(tables, k):
    train, hidden, vectors, counts = tables
    p = rec.profiles(train, vectors).join(hidden.select("user_id"), "user_id", "left_semi")
    cut = lambda d, lo, n: d.withColumn("v", F.slice("v", lo, n))
    lists = {"content": rec.vector_recs(p, vectors, train, k), "cf": rec.vector_recs(cut(p, 17, 16), cut(vectors, 1, 16), train, k)}
    lists["popularity"] = rec.popular_unseen(hidden.select("user_id"), train, rec.popular_places(counts), k).withColumn("score", F.col("n").cast("double")).drop("n")
    ch = None
    for c, d in lists.items():
        d = d.select("user_id", "product_id", "score", "rank", F.lit(c).alias("channel"))
        ch = d if ch is None else ch.unionByName(d)
    ch = ch.cache()
    return lists | {"weighted": fu.weighted(ch, "user_id", "product_id", WEIGHTS), "rrf": fu.rrf(ch, "user_id", "product_id")}


VIEWS = {"content": (slice(None), slice(None)), "cf": (slice(16, 32), slice(0, 16))}


@pytest.mark.parametrize("methods", [["cf"], ["weighted"], ["content", "cf", "popularity", "weighted", "rrf"]])
def test_ranks_are_those_in_the_lists(spark, tables, monkeypatch, methods):
    monkeypatch.setattr(ve, "BLOCK", 9)
    monkeypatch.setattr(bl, "QUERIES", 7)
    train, hidden, vectors, counts = tables
    got = {(r.user_id, r.method): r["rank"] for r in rec.hidden_ranks(train, hidden, vectors, methods, WEIGHTS, 12, VIEWS, counts).collect()}
    lists = listed(tables, 12)
    want = {}
    for m in methods:
        ranks = hidden.join(lists[m].select("user_id", "product_id", "rank"), ["user_id", "product_id"], "left")
        want |= {(r.user_id, m): r["rank"] for r in ranks.collect()}
    assert got == want and any(want.values()) and not all(want.values())
