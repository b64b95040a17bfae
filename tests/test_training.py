"""Pairwise-ranking factors: planted taste, blocks, and the edges."""

from __future__ import annotations

import numpy as np
import pytest

from vitrine.operators import bpr


def taste(spark, n=40):
    """Users like the items of their own parity; the last tenth of each user's items is left out."""
    rng = np.random.default_rng(1)
    rows = [(u, int(i)) for u in range(n) for i in rng.choice(np.arange(u % 2, 60, 2), 12, replace=False)]
    return rows, spark.createDataFrame(rows, "u bigint, i bigint")


def factors(df):
    return {r.id: np.array(r.v) for r in df.collect()}


@pytest.mark.parametrize("block", [1_000, 25])
def test_planted_taste_is_learned(spark, block):
    rows, df = taste(spark)
    f = bpr.train(df, dim=8, epochs=6, rate=0.1, held=0.1, batch=32, block=block)
    u, i = factors(f.users), factors(f.items)
    own = [u[a] @ i[b] for a in u for b in i if (a + b) % 2 == 0]
    other = [u[a] @ i[b] for a in u for b in i if (a + b) % 2]
    assert np.mean([x > y for x in own[::7] for y in other[::7]]) > 0.8
    assert f.losses[f.best_epoch - 1] == min(f.losses) < np.log(2)
    assert set(u) == {r[0] for r in rows} and all(np.isfinite(v).all() for v in [*u.values(), *i.values()])


def test_negatives_are_lacked():
    rng = np.random.default_rng(2)
    pairs = {(u, i) for u in range(5) for i in range(9) if rng.random() < 0.8 or u == 0} | {(1, i) for i in range(8)}
    known = np.sort([u * 9 + i for u, i in pairs])
    asked = np.array([0, 1, 1, 2, 3, 4] * 20)
    got = bpr._negatives(asked, known, 9, rng)
    for u, j in zip(asked, got):
        assert (j == -1) == all((u, i) in pairs for i in range(9)) and (u, j) not in pairs


def test_nulls_repeats_and_no_pairs(spark):
    f = bpr.train(spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, None), (2, 2)], "u bigint, i bigint"), dim=4, epochs=1, held=0.0)
    assert sorted(factors(f.users)) == [1, 2] and sorted(factors(f.items)) == [1, 2]
    none = bpr.train(spark.createDataFrame([], "u bigint, i bigint"), dim=4, epochs=2)
    assert none.users.count() == none.items.count() == 0


def test_sweep_takes_the_better_dimension(spark):
    _, df = taste(spark, 20)
    dim, f = bpr.sweep(df, (2, 4), epochs=2, rate=0.1, held=0.1, patience=1)
    assert dim in (2, 4) and len(f.users.first().v) == dim


def test_a_step_and_the_state_as_bytes():
    """Rows that recur take one step with their gradients added up; vectors go through bytes unchanged."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((5, 3))
    m, s, n, was = np.zeros((5, 3)), np.zeros((5, 3)), np.zeros(5, np.int64), v.copy()
    grad = rng.standard_normal((4, 3))
    bpr._adam(v, m, s, n, np.array([3, 1, 3, 0]), grad, 0.1)
    total = {3: grad[0] + grad[2], 1: grad[1], 0: grad[3]}
    for i in range(5):
        g = total.get(i, np.zeros(3))
        assert n[i] == (i in total) and np.allclose(v[i], was[i] - 0.1 * g / (np.abs(g) + 1e-8)) and np.allclose(m[i], 0.1 * g) and np.allclose(s[i], 0.001 * g * g)
    assert (bpr._table(bpr._bytes(v), 3) == v).all() and bpr._table([], 3).shape == (0, 3)
