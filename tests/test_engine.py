"""The façade over the smallest tables: every mode and method, and what it refuses."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.api import Engine, Invalid, NotFound, Unavailable
from vitrine.operators import bpr, learn
from vitrine.sources import artifacts

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def engine(spark):
    seen = spark.read.parquet(f"{FOLDER}/interactions.parquet").select("user_id", "product_id").dropna().distinct()
    hashed = seen.select(F.xxhash64("user_id").alias("u"), F.xxhash64("product_id").alias("i"))
    f = bpr.train(hashed, dim=4, epochs=1, held=0.0)
    name = lambda df, c: df.join(seen.select(c, F.xxhash64(c).alias("id")).distinct(), "id").select(F.col(c).alias("id"), "v")
    n = len(learn.FEATURES)
    return Engine(spark, FOLDER, bpr.Factors(name(f.users, "user_id"), name(f.items, "product_id")), (learn.Mlp(n, (3,)), np.zeros(n), np.ones(n)))


@pytest.fixture(scope="module")
def asked(spark, engine):
    users = [r[0] for r in engine.table("interactions").join(engine.table("users"), "user_id").groupBy("user_id").count().orderBy("count", "user_id").limit(2).select("user_id").collect()]
    v = [list(map(float, r.v)) for r in engine.vectors().orderBy("product_id").limit(2).collect()]
    title = [r.title for r in engine.table("products").where("title IS NOT NULL").orderBy("product_id").limit(2).collect()]
    return spark.createDataFrame([(i, title[i].split()[-1], v[i], users[i]) for i in range(2)], "query_id int, query string, v array<double>, user_id string")


def test_search_modes(engine, asked):
    kept = {}
    for name, options in {"keyword": {}, "semantic": {}, "rrf": {"mode": "hybrid"}, "ltr": {"mode": "hybrid", "fusion": "ltr"}, "personal": {"mode": "hybrid", "personal": {"content": 0.5, "cf": 0.5}}}.items():
        rows = engine.search(asked, **({"mode": name} | options)).collect()
        kept[name] = rows
        for q in (0, 1):
            ranks = sorted(r["rank"] for r in rows if r.query_id == q)
            assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 10
    assert kept["semantic"] and kept["ltr"] and kept["personal"]
    # with all candidates kept, a personal order is a permutation of the other
    ids = lambda rows: {(r.query_id, r.product_id) for r in rows}
    assert ids(engine.search(asked, mode="semantic", top_k=100).collect()) == ids(engine.search(asked, mode="semantic", top_k=100, personal={"content": 1.0}).collect())


def test_recommend_methods(engine, asked):
    seen = {tuple(r) for r in engine.table("interactions").select("user_id", "product_id").distinct().collect()}
    for method in ("content", "cf", "popular", "hybrid"):
        rows = engine.recommend(asked.select("user_id"), method, 5).collect()
        assert not {(r.user_id, r.product_id) for r in rows} & seen, method
        assert all(r["rank"] <= 5 for r in rows)
    assert engine.recommend(asked.select("user_id"), "cf", 5).count() > 0


def test_refusals(spark, engine, asked):
    bare = Engine(spark, FOLDER)
    for options in ({"mode": "hybrid", "fusion": "ltr"}, {"personal": {"cf": 1.0}}):
        with pytest.raises(Unavailable):
            bare.search(asked, **options)
    with pytest.raises(Unavailable):
        bare.recommend(asked.select("user_id"), "cf")
    for options in ({"personal": {}}, {"personal": {"brand": 1.0}}, {"personal": {"content": 1.0}, "gamma": 0.9}):
        with pytest.raises(Invalid):
            engine.search(asked, **options)
    with pytest.raises(NotFound):
        engine.search(asked.withColumn("user_id", F.lit("nobody")), personal={"content": 1.0})


def test_factors_round_trip(spark, engine, tmp_path):
    artifacts.save_factors(engine.factors, str(tmp_path), "d1")
    back = artifacts.load_factors(spark, str(tmp_path), "d1")
    assert back.items.count() == engine.factors.items.count()
    with pytest.raises(artifacts.Incompatible):
        artifacts.load_factors(spark, str(tmp_path), "d2")


def test_dropout_and_choice_of_the_network():
    rng = np.random.default_rng(0)
    worse = rng.standard_normal((400, 5))
    better = worse + np.array([1.0, 0, 0, 0, 0]) + 0.3 * rng.standard_normal((400, 5))
    model, losses, hidden = learn.choose_ranknet(better, worse, ((), (4,)), epochs=20, rate=0.02)
    assert hidden in ((), (4,)) and min(losses) < 0.5
    assert np.mean(model.score(better) > model.score(worse)) > 0.8
    # the dropped units get no gradient
    m = learn.Mlp(5, (4,))
    mask = np.array([[0.0, 2.0, 0.0, 2.0]])
    acts = m.forward(worse[:1], mask)
    g = m.gradients(acts, np.ones((1, 1)), mask)
    assert acts[1][0, 0] == acts[1][0, 2] == 0 and not g[0][0][:, [0, 2]].any()
