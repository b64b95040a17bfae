"""Hand-computed values of the operators."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.api import Engine, Invalid
from vitrine.functions import clean as cl
from vitrine.functions import text as tx
from vitrine.operators import evaluate as ev
from vitrine.operators import fusion as fu
from vitrine.operators import history as hist
from vitrine.operators import ingest as ing
from vitrine.operators import kcore, learn
from vitrine.operators import keyword as kw
from vitrine.operators import personal as pe
from vitrine.operators import ranking as rk
from vitrine.operators import recommend as rec
from vitrine.operators import vectors as ve
from vitrine.operators.numbering import dense_ids


def one(df):
    return df.collect()[0][0]


def order(df, key="product_id"):
    return [r[key] for r in df.orderBy("rank").collect()]


CH = "query_id int, product_id string, channel string, rank int, score double"
TWO = [(1, "A1", "k", 1, 3.0), (1, "B2", "k", 2, 2.0), (1, "C3", "k", 3, 1.0), (1, "C3", "s", 1, 0.9), (1, "A1", "s", 2, 0.6), (1, "D3", "s", 3, 0.3)]


def test_rrf_and_weighted(spark):
    d = spark.createDataFrame(TWO, CH)
    r = fu.rrf(d, "query_id", "product_id")
    assert order(r) == ["A1", "C3", "B2", "D3"]
    assert {x.product_id: x.score for x in r.collect()}["A1"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    w = fu.weighted(d, "query_id", "product_id", {"k": 0.5, "s": 0.5})
    assert {x.product_id: x.score for x in w.collect()} == {"A1": 0.75, "C3": 0.5, "B2": 0.25, "D3": 0.0}
    with pytest.raises(ValueError):
        fu.check_weights({"k": 0.7, "s": 0.7})


def test_weights_follow_available_channels(spark):
    d = spark.createDataFrame([(1, "A", "content", 1, 2.0), (1, "B", "content", 2, 1.0), (1, "B", "popularity", 1, 9.0)], CH)
    w = {r.product_id: r.score for r in fu.weighted(d, "query_id", "product_id", {"content": 0.6, "cf": 0.3, "popularity": 0.1}).collect()}
    assert w["A"] == pytest.approx(0.6 / 0.7) and w["B"] == pytest.approx(0.1 / 0.7)
    assert fu.weighted(d, "query_id", "product_id", {"content": 0.0, "cf": 1.0, "popularity": 0.0}).count() == 0


def test_minmax_depth_and_ties(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "c", 1.0), (2, "d", 3.0), (2, "e", 5.0)], "q int, product_id string, score double")
    n = {r.product_id: r.norm for r in rk.with_minmax(d, ["q"], "score").collect()}
    assert n == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.5, "e": 1.0}
    assert [rk.candidate_depth(*a) for a in [(10,), (30,), (100,), (1,), (80, None, 200), (10, 250), (80, 40)]] == [100, 150, 500, 100, 200, 250, 80]
    t = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", math.nan), (1, "d", math.inf), (1, "e", None), (1, "a", 0.5)], "q int, product_id string, score double")
    assert order(rk.top_k(t, ["q"], "score", "product_id", 2)) == ["a", "b"]


def test_top_k_equals_sorting(spark):
    rng = np.random.default_rng(4)
    data = [(int(q), f"i{i:03}", float(rng.integers(6))) for q in range(4) for i in range(128)]
    d = spark.createDataFrame(data, "q int, product_id string, score double")
    for k in (1, 7, 128):
        got = sorted((r.q, r.rank, r.product_id) for r in rk.top_k(d, ["q"], "score", "product_id", k).collect())
        want = [(q, i + 1, x[1]) for q in range(4) for i, x in enumerate(sorted((x for x in data if x[0] == q), key=lambda x: (-x[2], x[1]))[:k])]
        assert got == want


def test_hidden_rank_and_nearest_rank(spark):
    s = spark.createDataFrame([(1, "b", 0.8), (1, "c", 0.1), (1, "a", 0.1)], "q int, product_id string, score double")
    h = spark.createDataFrame([(1, "c")], "q int, product_id string")
    assert rk.hidden_rank(s, h, ["q"], "score", "product_id").collect()[0].rank == 3
    assert one(spark.range(1).select(rk.nearest_rank(F.array(*[F.lit(x) for x in (5, 1, 3)]), 0.95))) == 5


def test_cleaning(spark):
    f = lambda c: one(spark.range(1).select(c))
    s = lambda x: F.lit(x).cast("string")
    assert [f(cl.clean_string(s(x))) for x in (None, "  ", "N/A", " a b ", "NaN", " x　")] == [None, None, None, "a b", None, "x"]
    assert [f(cl.parse_price(s(x))) for x in ("$1,299.50", "12", "abc", None, "")] == [1299.5, 12.0, None, None, None]
    assert [f(cl.parse_rating(s(x))) for x in ("4.5", "0", "nan", "6", None)] == [4.5, None, None, None, None]
    assert f(F.unix_micros(cl.parse_epoch(F.lit(1_600_000_000_123)))) == 1_600_000_000_123_000 and f(F.unix_micros(cl.parse_epoch(F.lit(1_600_000_000)))) == 1_600_000_000_000_000
    assert f(cl.parse_epoch(F.lit(-5))) is None
    assert f(cl.json_map(s('{"a": 1, "b": null}'))) == {"a": "1", "b": None} and f(cl.json_map(s("[1]"))) == {} and f(cl.json_map(s('{"a": '))) == {}
    assert f(cl.first_other(F.array(F.lit("Beauty"), F.lit("Hair")), F.lit("Beauty"))) == "Hair" and f(cl.first_other(F.array(F.lit("Beauty")), F.lit("Beauty"))) == "Beauty"
    assert f(cl.searchable_text(s(" A\n b "), s(None), s("c"))) == "A b\nc"
    assert f(cl.labelled_text(title=s("T"), brand=s(" "))) == "Title: T"


def test_text(spark):
    f = lambda c: one(spark.range(1).select(c))
    assert f(tx.tokens(F.lit("O'Reilly SPF/50"))) == ["o", "reilly", "spf", "50"]
    assert f(tx.tokens(F.lit(None).cast("string"))) == []
    assert f(tx.title_query(F.lit("Howard LC0008 Leather Conditioner 8 Ounce"))) == "leather conditioner"
    assert f(tx.title_query(F.lit("Pack"))) is None
    assert f(tx.attribute_query(F.lit("Howard LC0008 Leather Conditioner 8 Ounce"), F.lit("Howard Products"))) == "howard conditioner"
    assert [f(tx.stem(F.lit(x))) for x in ("creams", "berries", "glass", "dishes", "us")] == ["cream", "berry", "glass", "dishe", "us"]
    q = tx.parse_web_query('balm "leather care" -wax or soap the')
    assert (q.groups, q.without) == ([[["balm"], ["leather", "care"]], [["soap"]]], [["wax"]])
    assert tx.parse_web_query("'; DROP TABLE --\"").groups == [[["drop"], ["table"]]]


def test_keyword_search(spark):
    p = spark.createDataFrame([("P1", "Leather Balm", "Acme", "for shoes", "Care", None), ("P2", "Soap", "Acme", "leather smell", "Bath", None), ("P3", "Creams", None, None, None, None), ("P4", "Cream", None, None, None, None)], "product_id string, title string, brand string, description string, category string, subcategory string")
    q = spark.createDataFrame([(1, "leather"), (2, "the"), (3, "cream"), (4, "leather acme soap"), (5, None)], "query_id int, query string")
    hits = rk.ranked(kw.match_all(kw.query_terms(q, "query_id", "query"), kw.postings(p), "query_id"), ["query_id"], "score", "product_id")
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    assert got == {1: ["P1", "P2"], 3: ["P3", "P4"], 4: ["P2"]}
    cover = {(r.query_id, r.product_id): r.score for r in kw.cover_density(kw.query_terms(q, "query_id", "query"), kw.postings(p), "query_id").collect()}
    assert set(cover) == {(1, "P1"), (1, "P2"), (3, "P3"), (3, "P4"), (4, "P2")} and cover[1, "P1"] == 1.0
    assert kw._covers([[0, 5], [1]]) == pytest.approx(1 / 2 + 1 / 5)


def test_vectors(spark):
    v = spark.createDataFrame([("SRC", [1.0, 0.0, 0.0]), ("NEAR", [0.99, 0.01, 0.0]), ("FAR", [0.0, 0.0, 1.0]), ("BAD", [0.0, 0.0, 0.0])], "product_id string, e array<float>")
    u = v.where(ve.usable(F.col("e"), 3)).select("product_id", ve.unit(F.col("e")).alias("v"))
    q = u.where("product_id = 'SRC'").select(F.lit(1).alias("query_id"), "v")
    assert order(ve.exact_top_k(q, u, 2)) == ["SRC", "NEAR"]
    m = ve.mean_vector(u.select(F.lit(1).alias("k"), "v"), "k", dim=3).collect()[0].v
    assert math.isclose(sum(x * x for x in m), 1.0)
    opposite = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "k int, v array<double>")
    assert ve.mean_vector(opposite, "k", dim=2).count() == 0


def test_exact_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    d = spark.createDataFrame([(f"i{n:02}", r.tolist()) for n, r in enumerate(x)], "product_id string, v array<double>")
    q = d.select(F.col("product_id").alias("query_id"), "v")
    whole = sorted(map(tuple, ve.exact_top_k(q, d, 5).collect()))
    monkeypatch.setattr(ve, "BLOCK", 17)
    assert sorted(map(tuple, ve.exact_top_k(q, d, 5).collect())) == whole
    want = [(f"i{a:02}", f"i{b:02}") for a in range(60) for b in sorted(range(60), key=lambda b: (-(x[a] @ x[b]), b))[:5]]
    assert sorted((r[0], r[1]) for r in whole) == sorted(want)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "B", 1), (1, "A", 2), (2, "A", 1), (2, "X", 2), (2, "B", 3)], "q int, product_id string, rank int")
    rel = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, "Z"), (1, "A")], "q int, product_id string")
    m = {r.q: r for r in ev.metrics(ranked, rel, ["q"], "product_id", [2, 3]).collect()}
    assert (m[1].recall_2, m[1].precision_2, m[1].mrr) == (1.0, 0.5, 0.5) and m[1].ndcg_2 == pytest.approx(1 / math.log2(3))
    assert m[2].recall_3 == 1.0 and m[2].precision_3 == pytest.approx(2 / 3)
    assert (m[3].mrr, m[3].recall_3, m[3].ndcg_3) == (0.0, 0.0, 0.0)
    r = spark.createDataFrame([(1,), (None,), (0,), (30,)], "rank int").select(*ev.from_rank(F.col("rank"), F.lit(20))).collect()
    assert [x.mrr for x in r] == [1.0, 0.0, 0.0, 0.0]


def test_history_and_core(spark):
    e = spark.createDataFrame([("u", "A", 1, 1), ("u", "A", 2, 2), ("u", "C", 3, 3), ("u", "B", 2, 4), ("v", "A", 1, 5)], "user_id string, product_id string, occurred_at int, interaction_id int")
    s = {r.product_id: r.split for r in hist.leave_last(e).collect()}
    assert s == {"A": "train", "B": "train", "C": "test"}
    i = {r.product_id: r.split for r in hist.inner_split(hist.leave_last(e)).collect()}
    assert i == {"A": "train", "B": "validation"}
    assert [r.product_id for r in hist.first_seen_order(e).where("user_id = 'u'").orderBy("position").collect()] == ["A", "B", "C"]
    p = spark.createDataFrame([("u1", "p1"), ("u1", "p2"), ("u2", "p1"), ("u2", "p2"), ("u3", "p3"), ("u1", "p3")], "user_id string, product_id string")
    assert kcore.k_core(p, 2, 2).count() == 4 and kcore.k_core(p, 3, 3).count() == 0


def test_recommendations(spark):
    users = spark.createDataFrame([("u",), ("new",)], "user_id string")
    counts = spark.createDataFrame([("C", 1), ("A", 3), ("B", 3), ("D", 1)], "product_id string, n bigint")
    places = rec.popular_places(counts)
    assert [r.product_id for r in places.orderBy("place").collect()] == ["A", "B", "C", "D"]
    seen = spark.createDataFrame([("u", "A"), ("u", "C"), ("u", "D"), ("u", "gone")], "user_id string, product_id string")
    got = {(r.user_id, r.rank): r.product_id for r in rec.popular_unseen(users, seen, places, 2).collect()}
    assert got == {("u", 1): "B", ("new", 1): "A", ("new", 2): "B"}


def test_personal(spark):
    d = spark.createDataFrame([(1, "a", 2.0, 1, 0.1, None), (1, "b", 2.0, 2, 0.9, None), (1, "c", 2.0, 3, None, None), (2, "a", 1.0, 1, None, None), (2, "b", 0.5, 2, None, None)], "q int, product_id string, baseline_score double, baseline_rank int, content double, cf double")
    qs = [round(r.q_, 6) for r in pe.query_relevance(d.where("q = 1").withColumnRenamed("q", "k"), "k").withColumnRenamed("q", "q_").orderBy("baseline_rank").collect()]
    assert qs == [1.0, round(2 / 3, 6), round(1 / 3, 6)]
    base = d.withColumnRenamed("q", "k")
    assert order(pe.rerank(base.where("k = 1"), "k", "product_id", {"content": 0.7, "cf": 0.3}, 0.0)) == ["a", "b", "c"]
    assert order(pe.rerank(base.where("k = 2"), "k", "product_id", {"content": 0.7, "cf": 0.3}, 0.3)) == ["a", "b"]
    with pytest.raises(ValueError):
        pe.gated(F.lit(1.0), F.lit(1.0), 0.5)
    assert one(spark.range(1).select(pe.gated(F.lit(0.5), F.lit(1.0), 0.2))) == pytest.approx(0.6)


def test_learning(spark):
    d = spark.createDataFrame([(1, f"p{i}", i, r) for i, r in enumerate([1, 1, 0, 0, 0])], "q int, product_id string, place int, relevance int")
    p = sorted((r.positive, r.negative) for r in learn.hard_negative_pairs(d, "q", "product_id", "place", "relevance", 2).collect())
    assert p == [("p0", "p2"), ("p0", "p3"), ("p1", "p2"), ("p1", "p3")]
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((500, 25)), rng.standard_normal((500, 25))
    better = np.where((x[:, :1] > y[:, :1]), x, y)
    worse = np.where((x[:, :1] > y[:, :1]), y, x)
    model, losses = learn.train_ranknet(better, worse, epochs=15)
    assert losses[-1] < losses[0] and (model.score(better) > model.score(worse)).mean() > 0.85
    assert one(spark.range(1).select(learn.softplus(F.lit(800.0)))) == 800.0
    z = learn.scale(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double"), ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]
    pos = spark.createDataFrame([("u", 0), ("u", 1)], "user_id string, item bigint")
    n = learn.negatives(pos, spark.createDataFrame([(4,)], "_n bigint"), "user_id", "item", 1).collect()
    assert all(r.negative in (2, 3) for r in n)


def test_every_positive_gets_a_negative(spark):
    """Users with nearly all items, whom eight draws mostly miss, and one with every item."""
    items = {"most": [i for i in range(1000) if i not in (0, 17, 18, 999)], "but_one": list(range(1, 1000)), "few": [3, 4]}
    pos = spark.createDataFrame([(u, i) for u, x in items.items() for i in x], "user_id string, item bigint")
    n = spark.createDataFrame([(1000,)], "_n bigint")
    got = learn.negatives(pos, n, "user_id", "item", 1).collect()
    assert sorted((r.user_id, r.item) for r in got) == sorted((u, i) for u, x in items.items() for i in x)
    assert all(0 <= r.negative < 1000 and r.negative not in items[r.user_id] for r in got)
    share = Counter(r.negative for r in got if r.user_id == "most")
    assert set(share) == {0, 17, 18, 999} and min(share.values()) > 180
    full = spark.createDataFrame([("all", i) for i in range(5)], "user_id string, item bigint")
    with pytest.raises(Exception, match="without an eligible negative"):
        learn.negatives(full, spark.createDataFrame([(5,)], "_n bigint"), "user_id", "item", 1).collect()


def test_ingest(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "id string, v string, created int")
    new = spark.createDataFrame([("b", "z", 9), ("c", "w", 9), ("b", "last", 9)], "id string, v string, created int")
    got = sorted(map(tuple, ing.latest_wins(old, new, ["id"], F.col("v"), keep=["created"]).collect()))
    assert got == [("a", "x", 1), ("b", "z", 1), ("c", "w", 9)]
    assert sorted(r.id for r in ing.insert_ignore(old, new, ["id"]).collect()) == ["c"]
    first = ing.dedupe_first(new.withColumn("n", F.monotonically_increasing_id()), ["id"], ["n"])
    assert {r.id: r.v for r in first.collect()} == {"b": "z", "c": "w"}
    d = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    assert {r.id: r.n for r in dense_ids(d, "id", "n").collect()} == {"a": 0, "b": 1, "c": 2}


def test_engine_checks_arguments(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    with pytest.raises(Invalid):
        e.search(spark.createDataFrame([(1, "x")], "query_id int, query string"), mode="magic")


def test_json_lines(spark, tmp_path):
    from vitrine.sources import files

    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"\n{"id": "3"}\n')
    good, bad = files.read_jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "id string")
    assert sorted(r.id for r in good.collect()) == ["1", "3"] and bad.count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string").collect()
    files.write_json_atomic(str(tmp_path / "m.json"), {"a": 1})
    assert (tmp_path / "m.json").exists()
