"""p2, p5, p6 on small tables with every kind of dirt, against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, defaultdict

from vitrine.operators import feature_table as ft
from vitrine.operators import orphans as orp
from vitrine.operators import skew

EVENTS = "user_id string, product_id string, event_type string, occurred_at timestamp, event_value double, key string, weight int"


def at(day: int, month: int = 1) -> dt.datetime:
    return dt.datetime(2024, month, day, 12)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ---- p5


def test_hot_keys_counts_modes_and_percentiles(spark):
    rng = random.Random(1)
    data = []
    for _ in range(3000):
        p = "hot" if rng.random() < 0.4 else f"p{rng.randrange(40)}"
        v = rng.choice([None, math.nan, math.inf, -math.inf, 0.0, -1.5, 2.0, 2.0, 7.25, 1e9, rng.random()])
        data.append((rng.choice([None, "u1", f"u{rng.randrange(90)}"]), rng.choice([p, p, p, None]), rng.choice(["a", "b", None]), at(rng.randrange(1, 28)), v, "clash", 1))
    df = spark.createDataFrame(data, EVENTS)
    got = {r.key: r for r in skew.per_key(df, "product_id", "user_id", "occurred_at", "event_type", "event_value").collect()}
    by = defaultdict(list)
    for r in data:
        if r[1] is not None:
            by[r[1]].append(r)
    assert set(got) == set(by)
    for k, rows in by.items():
        values = sorted(r[4] for r in rows if r[4] is not None and math.isfinite(r[4]))
        kinds = Counter(r[2] for r in rows if r[2] is not None)
        assert got[k].n_rows == len(rows)
        assert got[k].n_partners == len({r[0] for r in rows if r[0] is not None})
        assert got[k].latest == max(r[3] for r in rows)
        assert got[k].median_amount == (values[math.ceil(len(values) / 2) - 1] if values else None)
        assert got[k].top_kind == (min(kinds, key=lambda x: (-kinds[x], x)) if kinds else None)


def test_heavy_keys_count_nulls_among_all_rows(spark):
    data = [("u1", "a", "t", at(1), 1.0, "", 0)] * 3 + [(None, "b", "t", at(1), 1.0, "", 0)] * 2 + [("", None, "t", at(1), 1.0, "", 0)] * 5
    found = rows_of(skew.heavy_keys(spark.createDataFrame(data, EVENTS), ["product_id", "user_id"], 0.3))
    assert found == [("product_id", "a", 3), ("user_id", "", 5), ("user_id", "u1", 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENTS)
    assert skew.per_key(none, "product_id", "user_id", "occurred_at", "event_type", "event_value").count() == 0
    assert skew.heavy_keys(none, ["product_id", "user_id"], 0.01).count() == 0
    assert skew.hot_values(none, "product_id", 10).count() == 0
    assert ft.feature_table(none, ["view"]).count() == 0


def test_all_rows_of_one_key_and_long_keys(spark):
    long = "x" * 100_000
    data = [(long, long, "view", at(1), 3.0, "", 0)] * 4
    df = spark.createDataFrame(data, EVENTS)
    r = skew.per_key(df, "product_id", "user_id", "occurred_at", "event_type", "event_value").collect()
    assert [(x.n_rows, x.n_partners, x.median_amount) for x in r] == [(4, 1, 3.0)]
    assert len(skew.heavy_keys(df, ["product_id", "user_id"], 1.0).collect()) == 2


# ---- p2


def test_each_event_once_and_bad_values_left_out(spark):
    data = [
        ("u", "p", "view", at(1), 2.0, "", 0), ("u", "p", "view", at(1), 2.0, "", 0),  # delivered twice
        ("u", "p", "view", at(2), math.nan, "", 0), ("u", "p", "view", at(3), None, "", 0), ("u", "p", "view", at(4), -5.0, "", 0), ("u", "p", "view", at(5), 1e12, "", 0),
        ("u", "q", "view", at(5), 4.0, "", 0), ("u", None, "View", at(6), 1.0, "", 0), ("u", "p", None, None, math.inf, "", 0), (None, "p", "view", at(1), 2.0, "", 0), ("v", "p", "a.b", at(1), 0.0, "", 0),
    ]
    got = {r.user_id: r for r in ft.feature_table(spark.createDataFrame(data, EVENTS), ["a.b", "a-b", "view"]).collect()}
    u = got["u"]
    assert (u.view_n, u.view_total, u.view_latest_us) == (6, 6.0, int(at(5).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))
    assert (u.unlisted_n, u.unlisted_total) == (2, 1.0)
    assert (u.a_b_n, u.a_b_1_n, u.a_b_latest_us) == (0, 0, None)
    assert set(got) == {"u", "v"} and got["v"].a_b_n == 1


def test_states_merge_like_one(spark):
    rng = random.Random(2)
    data = [(f"u{rng.randrange(5)}", f"p{rng.randrange(9)}", rng.choice(["x", "y", "z", "w"]), at(rng.randrange(1, 28)), float(rng.randrange(5)), "", 0) for _ in range(400)]
    e = ft.distinct_events(spark.createDataFrame(data, EVENTS), "user_id", "product_id", "event_type", "occurred_at", "event_value").cache()
    types = ["x", "y", "z"]
    parts = [ft.sparse_states(e.where(f"day(at) % 3 = {i}"), types) for i in range(3)]
    flat = lambda d: rows_of(ft.expand(d, types, "u"))
    assert flat(ft.merge_states(*parts)) == flat(ft.sparse_states(e, types)) == flat(ft.merge_states(ft.merge_states(parts[2], parts[0]), parts[1]))


# ---- p6


def test_orphans_by_existence_and_time(spark):
    products = spark.createDataFrame([("a", at(5), at(20), 1), ("b", None, None, 1), ("c", at(1), None, 1), (None, at(1), None, 1)], "product_id string, created_at timestamp, removed_at timestamp, key int")
    data = [(1, "a", at(4)), (2, "a", at(5)), (3, "a", at(19)), (4, "a", at(20)), (5, "b", at(1)), (6, "zz", at(1)), (7, "", at(1)), (8, None, at(1)), (9, "A", at(6)), (10, "a", None), (11, "zz", None), (6, "zz", at(1))]
    df = spark.createDataFrame(data, "id bigint, product_id string, occurred_at timestamp")
    refs, alive = orp.references(df, "t", "id", "product_id", "occurred_at"), orp.lifetimes(products, "product_id", "created_at", "removed_at")
    assert rows_of(orp.orphans(refs, alive)) == [("t", i) for i in (1, 4, 6, 6, 9, 11)]
    counts = {r.month: r for r in orp.orphan_counts(refs, alive).collect()}
    assert (counts["2024-01"].n_references, counts["2024-01"].n_orphans, counts["2024-01"].n_orphan_keys) == (8, 5, 3)
    assert (counts[None].n_references, counts[None].n_orphans) == (2, 1)


def test_orphans_hot_and_light_agree_with_plain_loop(spark):
    rng = random.Random(3)
    life = {f"p{i}": (at(rng.randrange(1, 28)), rng.choice([None, at(rng.randrange(1, 28), 2)])) for i in range(0, 300, 2)}
    products = spark.createDataFrame([(k, *v) for k, v in life.items()], "product_id string, created_at timestamp, removed_at timestamp")
    data = [(i, "p0" if i % 3 == 0 else "p1" if i % 3 == 1 and i % 2 else f"p{rng.randrange(300)}", at(rng.randrange(1, 28), rng.randrange(1, 4))) for i in range(2000)]
    df = spark.createDataFrame(data, "id bigint, product_id string, occurred_at timestamp")
    want = [i for i, p, t in data if p not in life or t < life[p][0] or (life[p][1] and t >= life[p][1])]
    refs, alive = orp.references(df, "t", "id", "product_id", "occurred_at"), orp.lifetimes(products, "product_id", "created_at", "removed_at")
    assert rows_of(orp.orphans(refs, alive)) == [("t", i) for i in want]
    assert sum(r.n_orphans for r in orp.orphan_counts(refs, alive).collect()) == len(want)


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, product_id string, occurred_at timestamp, created_at timestamp, removed_at timestamp")
    some = spark.createDataFrame([(1, "x", at(1), None, None)], none.schema)
    life = lambda d: orp.lifetimes(d, "product_id", "created_at", "removed_at")
    refs = lambda d: orp.references(d, "t", "id", "product_id", "occurred_at")
    assert orp.orphans(refs(none), life(some)).count() == 0
    assert orp.orphans(refs(some), life(none)).count() == 1
    assert orp.orphan_counts(refs(none), life(none)).count() == 0
