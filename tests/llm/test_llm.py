"""The llm operators on small tables with every kind of dirt, against brute force, round trips and held-out labels."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.times import utc_day
from vitrine.llm import fusion_rank as fr
from vitrine.llm import listing_text as lt
from vitrine.llm import packing
from vitrine.llm import same_product as sp
from vitrine.llm import similar_vectors as sv
from vitrine.llm import text_quality as tq
from vitrine.llm import together as tg
from vitrine.llm import tokens as tk

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- p1

LISTING = "product_id string, title string, description string, brand string, store string, names string, kind int, price double"


def listings(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2.0) for r in rows], LISTING)


def test_reading_of_units():
    read = lambda t, d=None: (lambda r: (r[0], r[1]))(lt.read(t, d, None))
    meet = lambda x, y: any(a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for a in x for b in y)
    for a, b, same in [("500 ml", "16.9 fl oz", True), ("0.5 l", "50cl", True), ("12.5 g", "12,5 gr", True), ("120 g", "125 g", False), ("100 g", "3.5 oz", True), ("400 ml", ".4 litre", True), ("75 ml", "75 g", False)]:
        assert meet(read(a)[0], read(b)[0]) == same, (a, b)
    counts = {"12 x 300 g": 12, "Pack of 3": 3, "multipack 4 units": 4, "six-pack": 6, "Trio": 3, "twin pack": 2, "x2": 2, "2-Pack 30 cl": 2, "(2 count)": 2, "nothing": 1, "1x2": 1}
    assert {t: read(t)[1] for t in counts} == counts
    assert read("4 x 0.3 l")[0] == [("volume", 297.0, 303.0)]
    assert lt.read(None, None, None) == ([], 1, [], [])
    assert [s[1] for s in lt.read("Ça <b>Crème</b>, 07 Dune", "x &amp; y", "Ŵ")[2]] == [["ca"], ["creme"], ["7", "dune"], ["x"], ["y"]] or lt.read("Ça", None, "Ŵ")[3] == ["w"]


def test_unlike_articles_of_unseen_words_stay_apart(spark):
    rows = [
        ("a1", "Velmora Aurel Hand Cream Argan 75 ml", None, "Velmora", "s1"), ("a2", "Velmora Aurel Hand Cream Lotus 75 ml", None, "Velmora", "s2"), ("a3", "75 ml hand cream AUREL argan, Velmora", "", None, "s3"),
        ("b1", "Zorin Desk Lamp 40 cm black", None, "Zorin", "s1"), ("b2", "Zorin Desk Chair 90 cm red", None, "Zorin", "s2"), ("b3", "Zorin Desk Lamp 40 cm black Pack of 3", None, "Zorin", "s3"),
        ("c1", "Kumo Teal 120 g", None, None, "s1"), ("c2", "Kumo Teal 125 g", None, None, "s2"), ("c3", "Kumo Teal 0.12 kg", None, None, None), ("c4", "Kumo Teal 4.2 oz", None, None, None),
        ("d1", None, None, None, None), ("d2", "", "", "", ""), ("e1", "x" * 200_000, "y " * 50_000, None, "s1"),
        ("a1", "Velmora Aurel Hand Cream Argan 75 ml", None, "Velmora", "s1"), (None, "Velmora Aurel Hand Cream Argan 75 ml", None, "Velmora", "s9"),
    ]
    assert rows_of(sp.same_product_pairs(listings(spark, rows))) == [("a1", "a3"), ("c1", "c3"), ("c1", "c4"), ("c3", "c4")]
    assert sp.same_product_pairs(listings(spark, [])).count() == 0
    assert sp.same_product_pairs(listings(spark, rows[10:12])).count() == 0


def catalogue(seed: int, n_lines: int, hot: int = 0):
    """Listings in invented words with the article of each: kinds of three wordings, variants of two, praise, boilerplate, slips, converted
    units. The first article has ``hot`` more listings, all of one store."""
    rng = random.Random(seed)
    word = lambda n=3: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    kinds = [[f"{word()} {w}", f"{word()} {w}", f"{w} {word(2)} {word()}"] for w in (word() for _ in range(12))]
    variants = [(word(), f"{rng.randint(30, 90)} {word()}") for _ in range(20)]
    praise = [f"{word(2)} {word(2)}" for _ in range(10)]
    boiler = [" ".join(word(2) for _ in range(6)) for _ in range(10)]
    sizes = {50: ["50 ml", "5 cl", "1.7 fl oz"], 100: ["100ml", "0.1 l", "3.4 fl oz"], 250: ["250 ml", "25cl", "8.5 fl oz"]}
    makers = [word(4) for _ in range(n_lines // 4)]
    rows, truth = [], {}
    for line in range(n_lines):
        name, maker = word(4), rng.choice(makers)
        for article in {(rng.randrange(12), rng.randrange(20), rng.choice([50, 100, 250]), rng.choice([1, 1, 3])) for _ in range(rng.randint(1, 2))}:
            stores = rng.sample(range(40), rng.choice([1, 2, 3, 5])) + [99] * (hot if not truth else 0)
            for store in stores:
                k, v, size, n = article
                said = name if rng.random() > 0.05 else name[:3] + name[4:]
                parts = [f"{maker if rng.random() < 0.7 else ''} {said} {rng.choice(kinds[k])}", rng.choice(variants[v]), rng.choice(sizes[size]), f"pack of {n}" if n > 1 else ""]
                pid = f"p{len(truth):05d}"
                truth[pid] = (line, *article)
                rows.append((pid, ", ".join([*(p for p in parts if p), *rng.sample(praise, rng.randint(0, 2))]), ". ".join(rng.sample(boiler, 2)), maker if rng.random() < 0.8 else None, f"s{store}"))
    return rows, truth


@pytest.mark.parametrize("hot", [0, 600])
def test_unseen_catalogue_is_matched(spark, monkeypatch, hot):
    monkeypatch.setattr(sp, "CHUNK", 64)
    monkeypatch.setattr(sp, "SETS", 8)
    rows, truth = catalogue(3, 400, hot)
    found = {tuple(r) for r in sp.same_product_pairs(listings(spark, rows)).collect()}
    articles: dict[tuple, list[str]] = {}
    for pid, article in truth.items():
        articles.setdefault(article, []).append(pid)
    true = {p for ids in articles.values() for p in itertools.combinations(sorted(ids), 2)}
    assert len(found & true) >= 0.9 * len(true)
    assert len(found & true) >= 0.98 * len(found)


def test_a_line_name_of_many_makers_is_a_name(spark):
    """12,000 listings of 200 makers; one line name is in three listings of each of four makers, a plain word in one of each of 12 makers."""
    from vitrine.llm import word_evidence as we

    brand = F.concat(F.lit("maker"), (F.col("id") % 200).cast("string"))
    of_line, plain = (F.col("id") < 600) & (F.col("id") % 200 < 4), (F.col("id") >= 600) & (F.col("id") < 612)
    words = F.array_compact(F.array(F.lit("cream"), brand, F.when(of_line, "velmora"), F.when(plain, "argan")))
    kinds = we.word_kinds(spark.range(12_000).select(F.col("id").cast("string").alias("lid"), F.array(brand).alias("brand_words"), words.alias("words")))
    kind = {r.w: r.kind for r in kinds.collect()}
    assert (kind["velmora"], kind["argan"], kind["cream"], kind["maker7"]) == ("line", "word", "word", "maker")


def test_what_a_shared_word_implies_is_no_conflict(spark):
    side = "lines array<string>, makers array<string>, words array<string>, pairs array<string>, tells array<struct<u:string,ws:array<string>,implied:array<string>>>"
    fields = ", ".join(f"{p}_{f}" for p in "ab" for f in side.replace(", ", "|").split("|")).replace("ws:array<string>|", "ws:array<string>,")
    a = (["velmora"], ["zorin"], ["10", "coral", "gel"], [], [("10", ["coral"], ["coral"]), ("coral", ["10"], IMPLIED := ["10"])])
    for implied, score in ((IMPLIED, 0.9), ([], 0.0)):
        told = [(u, ws, implied and i) for u, ws, i in a[4]]
        row = (*a[:4], told, ["velmora"], ["zorin"], ["brow", "coral", "gel"], [], told[1:])
        assert [r.score for r in sp.scored(spark.createDataFrame([row], fields)).collect()] == [pytest.approx(score)]


def test_matching_is_of_maximum_weight():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = np.round(rng.random((rng.integers(1, 5), rng.integers(1, 5))) * (rng.random() < 0.9), 2)
        n, m = w.shape
        small = w if n <= m else w.T
        best = max(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        pairs = sp.best_matching(w)
        assert sum(w[i, j] for i, j in pairs) == pytest.approx(best)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


def test_merge_refuses_inconsistent_cycles():
    links = {("a", "b"): 1.0, ("b", "c"): 0.9, ("c", "d"): 1.0}
    whole = {("a", "b"): 2, ("b", "c"): 1, ("c", "d"): 1}
    assert len(set(sp.merge_component(whole, links, set()).values())) == 1
    # a and d state different things, so the weakest link of the chain gives way
    assert sp.merge_component(whole, links, {("a", "d")}) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    # unmatched pairs join only if their score is high
    assert sp.merge_component({}, links | {("b", "c"): 0.6}, set()) == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_supports_of_chunks_add_up():
    rng = random.Random(4)
    classes = [f"c{i}" for i in range(8)]
    links = {p: rng.choice([0.5, 0.8, 1.0]) for p in itertools.combinations(classes, 2) if rng.random() < 0.6}
    sets = [(sorted(rng.sample(classes, rng.randint(1, 3))), rng.randint(1, 3)) for _ in range(9)]
    whole = Counter(sp.supports(sets, None, links))
    parts = Counter(sp.supports(sets[:4], None, links)) + Counter(sp.supports(sets[4:], None, links)) + Counter(sp.supports(sets[:4], sets[4:], links))
    assert whole == parts


def test_components(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(40)] + [("z1", "z2", 1.0)], "a string, b string, score double")
    assert {r.component for r in sp.components(links).collect()} == {"n000", "z1"}


# ---- p3

CAND = "request string, item string, a double, b double, has boolean, points int, n int"


def plain_borda(rows, weights):
    by = {}
    for r, i, *s in rows:
        if r is not None and i is not None:
            cell = by.setdefault(r, {}).setdefault(i, [None] * len(s))
            for k, v in enumerate(s):
                if v is not None and math.isfinite(v):
                    cell[k] = v if cell[k] is None else max(cell[k], v)
    out = []
    for r, items in by.items():
        n, points = len(items), Counter({i: 0.0 for i in items})
        for k, w in enumerate(weights):
            have = [c[k] for c in items.values() if c[k] is not None]
            for i, c in items.items():
                if c[k] is None:
                    points[i] += w * (n - 1) * 0.5
                else:
                    rank = 1 + sum(x > c[k] for x in have) + (have.count(c[k]) - 1) / 2
                    points[i] += w * (n - rank)
        for place, i in enumerate(sorted(items, key=lambda i: (-round(points[i], 7), i)), 1):
            out.append((r, i, place))
    return sorted(out)


@pytest.mark.parametrize("hot", [10**9, 1])
def test_borda_equals_plain(spark, monkeypatch, hot):
    """Once by windows alone, once with a request of most rows on the spread way, its ties by ranges."""
    monkeypatch.setattr(fr, "BIG_TIE", 20)
    rng = random.Random(7)
    score = lambda: rng.choice([None, math.nan, math.inf, 1.0, 1.0, 2.0, rng.random() * 1e6, -3.5])
    data = [("big", f"i{j:05}", score(), rng.choice([0.0, 1.0])) for j in range(1500)] + [(f"r{j % 9}", f"i{rng.randrange(40)}", score(), score()) for j in range(300)]
    data += [("tied", f"i{j}", 5.0, None) for j in range(7)] + [("one", "x", None, None), (None, "x", 1.0, 1.0), ("r1", None, 1.0, 1.0)]
    df = spark.createDataFrame([(*d, True, 1, 2) for d in data], CAND)
    rows = fr.candidates(df, "request", "item", {"a": ("a", None), "b": ("b", "has")})
    got = sorted((r.request, r.item, r.place) for r in fr.borda(rows, {"a": 1.0, "b": 2.0}, hot if hot > 1 else 2).collect())
    assert got == plain_borda(data, [1.0, 2.0])


def test_borda_scale_does_not_matter_and_empty(spark):
    data = [("r", f"i{j}", float(j), float(-j)) for j in range(9)]
    rank = lambda f: {r.item: r.place for r in fr.borda(fr.candidates(spark.createDataFrame([(r, i, f(a), b, True, 1, 1) for r, i, a, b in data], CAND), "request", "item", {"a": ("a", None), "b": ("b", None)}), {"a": 1.0, "b": 1.0}).collect()}
    assert rank(lambda x: x) == rank(lambda x: math.exp(9 * x))
    none = fr.candidates(spark.createDataFrame([], CAND), "request", "item", {"a": ("a", None)})
    assert fr.borda(none, {"a": 1.0}).count() == 0


# ---- p4

EVENT = "user_id string, product_id string, occurred_at timestamp, n int, item string, chunk int"


def plain_together(data, least, ratio):
    baskets = {}
    for u, p, t in data:
        if None not in (u, p, t):
            baskets.setdefault((u, t.date()), set()).add(p)
    n, single, pair = len(baskets), Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        pair.update(itertools.combinations(sorted(b), 2))
    return sorted((a, b, c, round(c * n / (single[a] * single[b]), 9)) for (a, b), c in pair.items() if c >= least and c * n / (single[a] * single[b]) >= ratio)


@pytest.mark.parametrize("chunk", [3, 1000])
@pytest.mark.parametrize(("least", "ratio"), [(1, 0.0), (2, 1.5), (3, 4.0)])
def test_pairs_equal_plain(spark, monkeypatch, chunk, least, ratio):
    monkeypatch.setattr(tg, "CHUNK", chunk)
    rng = random.Random(8)
    data = [(rng.choice(["hot", "u1", "u2", f"u{rng.randrange(30)}", None]), rng.choice(["top", "", None, f"p{rng.randrange(25)}"]), rng.choice([None, *[dt.datetime(2024, 1, d, 23, 59) for d in range(1, 9)]])) for _ in range(900)]
    df = spark.createDataFrame([(*d, 1, "clash", 0) for d in data], EVENT)
    got = sorted((r.item_a, r.item_b, r.n_ab, round(r.ratio, 9)) for r in tg.together(df, "user_id", "product_id", utc_day(F.col("occurred_at")), least, ratio).collect())
    assert got == plain_together(data, least, ratio)


def test_no_baskets(spark):
    assert tg.together(spark.createDataFrame([], EVENT), "user_id", "product_id", utc_day(F.col("occurred_at")), 1, 0.0).count() == 0


def test_pairs_of_one_shared_basket_come_out(spark, tmp_path):
    from vitrine.llm import load

    day = lambda d: dt.datetime(2024, 1, d, 12)
    data = [("u1", "a", day(1)), ("u1", "b", day(1)), ("u1", "c", day(1)), ("u2", "a", day(1)), ("u2", "b", day(1)), ("u3", "d", day(2))]
    spark.createDataFrame([(*d, 1, "clash", 0) for d in data], EVENT).write.parquet(str(tmp_path / "interactions.parquet"))
    got = sorted((r.product_id_a, r.product_id_b, r.n_ab, round(r.ratio, 6)) for r in load().queries["p4_all_pairs"](spark, str(tmp_path)).collect())
    assert got == [(*k[:3], round(k[3], 6)) for k in plain_together(data, 1, 0.0)] == [("a", "b", 2, 1.5), ("a", "c", 1, 1.5), ("b", "c", 1, 1.5)]


# ---- p7


def vectors_of(n=700, dim=64, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[n // 2 :] = x[: n - n // 2] + 0.15 * rng.standard_normal((n - n // 2, dim))
    return x.astype(np.float32)


def test_similar_vectors_against_brute_force(spark):
    x = vectors_of()
    copies = [(f"c{i:03}", (x[0] * (1 + i % 3)).tolist()) for i in range(40)]  # a hot group of one direction
    bad = [("n1", None), ("n2", []), ("n3", [1.0] * 63), ("n4", [0.0] * 64), ("n5", [math.nan] * 64), ("n6", [math.inf] + [1.0] * 63), (None, [1.0] * 64)]
    rows = [(f"v{i:03}", v.tolist()) for i, v in enumerate(x)] + copies + bad
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "product_id string, embedding array<float>, n int, cid string")
    valid = sorted((p, np.array(v, np.float32).astype(float)) for p, v in rows if p and v and len(v) == 64 and np.isfinite(v).all() and any(v))
    ids, m = [p for p, _ in valid], np.array([v for _, v in valid])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(m @ m.T, 7)
    np.fill_diagonal(cos, -9)
    order = np.argsort(-cos, axis=1, kind="stable")[:, :10]
    got = {}
    for r in sv.similar(df, "product_id", "embedding").collect():
        got.setdefault(r.item, {})[r.place] = r.other
    assert set(got) == set(ids) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    recall = np.mean([len({ids[j] for j in order[i]} & set(got[p].values())) / 10 for i, p in enumerate(ids)])
    assert recall >= 0.9
    want = {tuple(sorted((p, ids[j]))) for i, p in enumerate(ids) for j in order[i] if cos[i, j] >= 0.9}
    found = set(map(tuple, sv.similar_pairs(df, "product_id", "embedding", 0.9).collect()))
    assert len(want & found) >= 0.99 * len(want) and len(found - want) <= 0.01 * len(want)


def test_near_copies_of_a_third_are_found(spark):
    """A third of the vectors are near copies (cosine about 0.97) that k-means spreads over many lists and whose codes say little."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 64))
    x[:1000] = x[0] / np.linalg.norm(x[0]) + 0.022 * rng.standard_normal((1000, 64))
    df = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], "product_id string, embedding array<float>")
    m = x.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(m @ m.T, 7)
    np.fill_diagonal(cos, -9)
    order = np.argsort(-cos, axis=1, kind="stable")[:, :10]
    want = {tuple(sorted((f"v{i:04}", f"v{j:04}"))) for i in range(len(x)) for j in order[i] if cos[i, j] >= 0.9}
    found = set(map(tuple, sv.similar_pairs(df, "product_id", "embedding", 0.9).collect()))
    assert len(want) > 5000 and len(want & found) >= 0.999 * len(want) and len(found - want) <= 0.001 * len(want)
    near = {}
    for r in sv.similar(df, "product_id", "embedding").where("item < 'v1000'").collect():
        near.setdefault(r.item, set()).add(r.other)
    assert np.mean([len({f"v{j:04}" for j in order[i]} & near[f"v{i:04}"]) / 10 for i in range(1000)]) >= 0.999


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(f"v{i}", [float(i + 1), 1.0] + [0.0] * 62) for i in range(n)], "product_id string, embedding array<float>")
    assert sv.similar(df, "product_id", "embedding").count() == n * (n - 1)


def test_lists_and_blocks_do_not_change_pairs(spark, monkeypatch):
    x = vectors_of(200)
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "product_id string, embedding array<float>")
    whole = rows_of(sv.similar_pairs(df, "product_id", "embedding", 0.9))
    monkeypatch.setattr(sv, "SHARD", 20)
    monkeypatch.setattr(sv, "BLOCK", 64)
    monkeypatch.setattr(sv, "LISTS", 3)
    assert rows_of(sv.similar_pairs(df, "product_id", "embedding", 0.9)) == whole


def test_near_pairs_send_no_vectors_to_pairs_of_blocks(spark):
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(vectors_of(200))], "product_id string, embedding array<float>")
    assert "CoGroup" not in sv.similar_pairs(df, "product_id", "embedding", 0.9)._jdf.queryExecution().toString()


@pytest.mark.parametrize("noise", [0.005, 0.02, 0.04, 0.1])
def test_groups_around_leaders_lose_no_neighbour(noise, monkeypatch):
    """One dense group and single vectors: as many blocks, tiles and pieces as the constants make, against all products."""
    monkeypatch.setattr(sv, "TILE", 64)
    monkeypatch.setattr(sv, "TILE_ROWS", 32)
    monkeypatch.setattr(sv, "PAIRS", 500)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x[:250] = x[0] / np.linalg.norm(x[0]) + noise * rng.standard_normal((250, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(400)]
    blocks = []
    for at in np.split(np.arange(400), [130, 300]):
        lead = sv.leaders(x[at])
        order = np.argsort(lead, kind="stable")
        start = np.append(np.nonzero(np.diff(lead[order], prepend=-1))[0], len(at))
        own = x[at][order].astype(float)
        radius = np.array([np.arccos(np.clip((own[lo:hi] @ own[lo]).min() - 1e-6, -1, 1)) if hi - lo > 1 else 0.0 for lo, hi in zip(start, start[1:])])
        ids = at[order].astype(object)
        blocks.append(sv.Block(ids, np.argsort(np.argsort(ids)), x[at][order], start, radius))
    found = {}
    for i, a in enumerate(blocks):
        bar = np.full(len(a.cids), 0.9 - sv.SLACK)
        for b in blocks[i:]:
            of_a, of_b = sv.near(a, b, 0.9, 5, bar)
            for best, own, others in [(of_a, a, b), (of_b, b, a)][: 1 if a is b else 2]:
                for e, o, c in zip(*best.kept()):
                    found.setdefault(own.cids[e], set()).add((-round(c, 7), others.cids[o]))
    cos = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(cos, -1)
    for i in range(400):
        want = sorted((-round(cos[i, j], 7), j) for j in range(400) if cos[i, j] >= 0.9)[:5]
        assert [p for p in sorted(found.get(i, ())) if p[0] <= -0.9][:5] == want


# ---- p8, p9

TEXTS = [None, "", " ", "\n\n  \t", "don't  stop", "naïve façade ½ ² Ⅷ", "日本語のテキスト", "👩‍🔬 ok", "a" * 5000, "x　y z\x85w\x1c\x1f", "<|endoftext|>", "＂１２３＂", "end   ", "​﻿", "It's 12,99 €\r\n!!", "ok", "ok", "\U00011f04 𞤀𞤁", "word " * 3000]


def documents(spark):
    rows = [(i, t, "clash", 1, [1]) for i, t in enumerate(TEXTS)] + [(4, "don't  stop", "clash", 1, [1]), (None, "no id", "clash", 1, [1])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, word string, pos int, ids array<int>")


def test_encoding_equals_the_library_and_decodes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = documents(spark)
    got = sorted(((r.doc_id, list(r.ids)) for r in tk.encode(docs).collect()), key=repr)
    want = sorted(((r.doc_id, t.encode(r.text, add_special_tokens=False).ids if r.text else []) for r in docs.collect()), key=repr)
    assert got == want
    back = sorted(((r.doc_id, r.text) for r in tk.decode(tk.encode(docs)).collect()), key=repr)
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in tk.token_counts(docs).collect()), key=repr) == sorted(((i, len(x)) for i, x in want), key=repr)


def test_encoding_of_empty_table(spark):
    none = documents(spark).limit(0)
    assert tk.encode(none).count() == 0 and tk.decode(tk.encode(none)).count() == 0


def test_containers_hold_everything_within_capacity(spark):
    rng = random.Random(10)
    sizes = [(i, rng.choice([None, 0, 1, 40, 99, 100, 101, 350, rng.randrange(120)])) for i in range(3000)] + [(7, 5), (7, 5), (None, 3), (9, -2)]
    caps = spark.createDataFrame([("a", 100), ("b", 1000), ("a", 100), ("zero", 0), ("none", None)], "pack_name string, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").repartition(6)
    out = packing.pack(df, caps, windows=8).collect()
    total = sum(max(0, s or 0) for _, s in sizes)
    for name, cap in (("a", 100), ("b", 1000)):
        mine = [r for r in out if r.pack_name == name]
        fill = Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= cap and sum(fill.values()) == total
        assert len(fill) <= 1.05 * total / cap + 8
        parts = Counter(r.doc_id for r in mine)
        for doc, size in sizes:
            if doc not in (None, 7, 9):
                assert parts[doc] == max(1, -(-max(0, size or 0) // cap))
    assert {r.pack_name for r in out} == {"a", "b"}
    assert packing.pack(df.limit(0), caps).count() == 0


def test_best_fit_falling():
    at = packing.best_fit_falling([(60, 1), (50, 2), (40, 3), (50, 4)], 100)
    assert at[1] == at[3] and at[2] == at[4] and len(set(at.values())) == 2


# ---- p10

COMMON = frozenset("the a and of it is was in to for no all this that i my der die und ist le la et est".split())


def statistics(spark, texts, window=tq.WINDOW):
    docs = spark.createDataFrame([(i, t, "clash", True) for i, t in enumerate(texts)], "doc_id bigint, text string, verdict string, single boolean")
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("xx", None)], "lang string, word string")
    return {r.doc_id: tuple(r)[1:] for r in tq.text_statistics(docs, words, window).collect()}


def chunks_of(text, window):
    import regex

    return regex.findall(tq.chunk_pattern(window), text)


@pytest.mark.parametrize("seed", range(6))
def test_chunks_merge_to_the_whole(seed):
    """All fields, verdict included, of random texts of all kinds, cut into chunks and merged in any order."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "it", "gel", "cream", "a", "soap", "x1", "é", "12", "it's", "日本の", "Ünder", "qwrtz"])
    run = lambda n: " ".join(word() for _ in range(n))
    more = 0
    for _ in range(60):
        text = ""
        for _ in range(rng.randrange(1, 9)):
            text += rng.choice(["- ", "", "1. ", "Name: ", "<p class='x'>", "&amp; ", "a,b,", "| x | y", "same words here again\n" * 3])
            text += run(rng.choice([3, 40, 200, 500])) + rng.choice([". ", "\n", "\r\n", "! ", " <br> ", "   ", " .... ", "</td>", "。", "\t", ", "])
        whole = tq.state_of(text, COMMON, COMMON)
        cut = chunks_of(text, rng.choice([1, 300, 700, 2000]))
        assert "".join(cut) == text
        parts = [tq.state_of(c, COMMON, COMMON, i == 0, i == len(cut) - 1) for i, c in enumerate(cut)]
        more += len(parts) > 2
        left = parts[0]
        for p in parts[1:]:
            left = tq.merge(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = tq.merge(p, right)
        assert left == right == whole
        assert tq.finish(left) == tq.finish(whole) and tq.verdict(left) == tq.verdict(whole)
    assert more > 10


@pytest.mark.parametrize("window", [5_000, tq.WINDOW])
def test_a_list_without_line_breaks_is_a_list_cut_or_not(spark, window):
    text = "- " + " - ".join(f"{a} {b} {c}" for a in ("hand", "face", "body") for b in ("cream", "balm", "wash", "scrub") for c in ("lilac", "amber", "tonka", "quince")) * 100
    assert len(text) > 79_889
    assert statistics(spark, [text], window)[0] == statistics(spark, [text], 10**7)[0]
    assert statistics(spark, [text], window)[0][-1] == "list"


def test_prose_in_other_scripts(spark):
    texts = [
        "这款面霜很好用，味道也不重。我每天早上都会用一点，皮肤变得很柔软。", "Этот крем мне очень понравился, запах лёгкий и не навязчивый. Я пользуюсь им каждый день и довольна.", "この化粧水はとても使いやすいです。毎日使っています。",
        "Αυτή η κρέμα είναι πολύ καλή και την χρησιμοποιώ κάθε μέρα στο πρόσωπο.", "Крем\nМыло\nДухи\nШампунь\nМаска", "化粧水\n乳液\n石鹸",
    ]
    assert [v[-1] for _, v in sorted(statistics(spark, texts).items())] == ["prose"] * 4 + ["list"] * 2


def test_sentence_words_are_fitted(spark):
    docs = spark.createDataFrame([(1, "it was in the box for me"), *((i, "gel for eyes\nbalm for feet") for i in (2, 3, 4)), (5, None), (None, "the the the")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "prose"), (2, "list"), (3, "list"), (4, "table"), (5, "junk"), (9, None), (None, "list")], "doc_id bigint, label string")
    assert tq.sentence_words(frozenset(["for", "the", "it", "a"]), docs, labels) == {"the", "it"}
    assert tq.sentence_words(frozenset(["for", "a"])) == {"for"}


def test_huge_texts_in_windows(spark):
    text = "\n".join(" ".join(f"The cream of {chr(97 + i % 26)}{chr(97 + j % 26)}u is fine, and it was in the box." for j in range(300)) for i in range(3))
    whole, cut = statistics(spark, [text])[0], statistics(spark, [text], 1000)[0]
    assert whole == cut and whole[-1] == "prose"


def test_statistics_of_edge_cases(spark):
    got = statistics(spark, [None, "", "  \n ", "It is.", "it is", "!!!", "The a.\nlist\n"])
    assert got[0] == got[1] == (0, 0, None, None, None, None, None)
    assert got[2][1] == 0 and got[2][-1] is None
    assert got[3] == (6, 2, 2.0, 1 / 6, 1.0, 1.0, "prose")
    assert got[4][4] == 0.0 and got[5][1] == 0 and got[6][4] == 0.5
    assert tq.text_statistics(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "word string")).count() == 0


def test_verdicts_agree_with_labels(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    read = lambda t: spark.read.parquet(f"{LARGER}/{t}.parquet")
    v = tq.text_statistics(read("documents"), read("common_words"), labels=read("doc_labels")).join(read("doc_labels"), "doc_id").select("label", "verdict").collect()
    right = sum((r.label == "prose") == (r.verdict == "prose") for r in v if r.verdict)
    assert right / len(v) >= 0.9


# ---- queries


def test_queries_run_on_the_smallest_tables(spark):
    from tests.compare import difference, views
    from vitrine.llm import load

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = views(FOLDER)
    r = load()
    for name, q in r.queries.items():
        if name in r.sql:
            assert difference(q(spark, FOLDER), r.sql[name], con) == "", name
        else:
            assert q(spark, FOLDER).count() >= 0
