"""The inverted file against brute force, on clustered vectors with a hot list, and the edges."""

from __future__ import annotations

import numpy as np
import pytest

from vitrine.operators import blocks as bl
from vitrine.operators import vectors as ve


def unit_rows(rng, n):
    centre = rng.standard_normal((12, 16))
    x = centre[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, 16))
    x[: n // 3] = centre[0] + 0.05 * rng.standard_normal((n // 3, 16))  # a third lies close together
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("part", [ve.PART, 50])
def test_inverted_file_finds_nearly_all(spark, monkeypatch, part):
    monkeypatch.setattr(ve, "PART", part)
    x = unit_rows(np.random.default_rng(3), 1_500)
    items = spark.createDataFrame([(f"p{i:04}", [float(a) for a in v], "clash") for i, v in enumerate(x)], "product_id string, v array<double>, score string")
    queries = items.where("product_id LIKE '%7'").select(items.product_id.alias("query_id"), "v")
    exact, found = ve.exact_top_k(queries, items, 10), ve.ivf_top_k(queries, items, 10)
    got = [r.recall for r in ve.recall(found, exact, 10).collect()]
    assert len(got) == 150 and np.mean(got) >= 0.9
    assert [r.rank for r in found.where("query_id = 'p0007'").orderBy("rank").collect()] == list(range(1, 11))
    # all lists probed is exact
    assert np.mean([r.recall for r in ve.recall(ve.ivf_top_k(queries, items, 10, share=1.0), exact, 10).collect()]) == 1.0


def test_inverted_file_of_few(spark):
    schema = "product_id string, v array<double>"
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<double>")
    assert ve.ivf_top_k(q, spark.createDataFrame([], schema), 3).count() == 0
    assert [tuple(r) for r in ve.ivf_top_k(q, spark.createDataFrame([("a", [0.0, 1.0])], schema), 3).collect()] == [("q", "a", 0.0, 1)]
    assert ve.ivf_top_k(q.where("false"), spark.createDataFrame([("a", [0.0, 1.0])], schema), 3).count() == 0


@pytest.mark.parametrize("k", [1, 7, 40])
def test_blocks_hold_no_more_than_the_best(k):
    """Each query keeps room for its k best and as many new ones, with ties by position and without what it has seen."""
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((30, 8)), rng.standard_normal((9_000, 8))
    y[4_000:4_400] = y[0]  # four hundred that tie
    x[0] = y[0]
    out = np.sort(rng.choice(30 * 9_000, 5_000, replace=False))
    seen = bl.Pairs.of([out[out // 9_000 == q] % 9_000 for q in range(30)])
    best = bl.Best(x, k)
    for lo in range(0, 9_000, 2_500):
        pos = np.arange(lo, min(lo + 2_500, 9_000))
        best.add(pos, y[pos], seen.within(pos))
    row, pos, score, rank = best.kept()
    s = bl.rounded(np.einsum("qd,nd->qn", x, y))
    s[seen.rows, seen.pos] = -np.inf
    for q in range(30):
        want = np.lexsort((np.arange(9_000), -s[q]))[:k]
        assert pos[row == q].tolist() == want.tolist() and rank[row == q].tolist() == list(range(1, k + 1)) and (score[row == q] == s[q][want]).all()
    others = bl.Best(x[1:], k)  # without ties few items pass the bar
    for lo in range(0, 9_000, 2_500):
        others.add(np.arange(lo, min(lo + 2_500, 9_000)), y[lo : lo + 2_500], (np.zeros(0, int), np.zeros(0, int)))
    assert others.score.shape[1] <= 4 * k + 16


def test_top_k_leaves_out_what_was_seen(spark, monkeypatch):
    monkeypatch.setattr(ve, "BLOCK", 7)
    items = spark.createDataFrame([(f"p{i:02}", [float(i % 5), 1.0]) for i in range(30)], "product_id string, v array<double>")
    users = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "user_id string, v array<double>")
    seen = spark.createDataFrame([("a", "p04"), ("a", "p09"), ("a", "p04"), ("a", "none"), (None, "p14")], "user_id string, product_id string")
    got = sorted(map(tuple, ve.exact_top_k(users, items, 3, "user_id", seen=seen).collect()), key=lambda r: (r[0], r[3]))
    assert got == [("a", "p14", 4.0, 1), ("a", "p19", 4.0, 2), ("a", "p24", 4.0, 3), ("b", "p00", 0.0, 1), ("b", "p05", 0.0, 2), ("b", "p10", 0.0, 3)]
    assert ve.exact_top_k(users, items.where("false"), 3, "user_id", seen=seen).count() == 0
