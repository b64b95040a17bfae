"""Matrix factorisation by Bayesian personalised ranking (Rendle et al. 2009), trained in strata (Gemulla et al. 2011).

Users and items are cut into blocks. An epoch has as many rounds as there are blocks; in each, every user block meets another item block, so
all tasks of a round change rows that no other task holds. A task samples the negatives of its pairs from its item block, where it knows all
of its users' items. Factors and their Adam moments live in tables of the shared folder between rounds; nothing of them is broadcast or
brought to the driver but the losses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.plans.storage import discard, materialize

#: Users or items of a block, at most about.
BLOCK = 65_536
SCALE = 0.01
#: Vectors go as the bytes of their doubles: as arrays, turning them into rows and back takes several times as long as the training.
_STATE = "side int, id bigint, v binary, m binary, s binary, n int"
_OUT = _STATE + ", loss double, pairs bigint"


@dataclass
class Factors:
    """users and items: id, v; losses: the loss on held-out pairs after each epoch."""

    users: DataFrame
    items: DataFrame
    losses: list[float] = field(default_factory=list)
    best_epoch: int = 0


def _start(ids: DataFrame, side: int, dim: int, seed: int) -> DataFrame:
    """Normal values of deviation SCALE that depend on side, id and seed alone."""

    def run(batches):
        for b in batches:
            v = [(np.random.default_rng([seed, side, int(i) % (1 << 64)]).standard_normal(dim) * SCALE).tobytes() for i in b.id]
            zero = [np.zeros(dim).tobytes()] * len(b)
            yield pd.DataFrame({"side": np.int32(side), "id": b.id, "v": v, "m": zero, "s": zero, "n": np.int32(0)})

    return ids.select(F.col("id").cast("bigint").alias("id")).mapInPandas(run, _STATE)


def _table(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim).copy()


def _bytes(table: np.ndarray) -> list[bytes]:
    raw, width = table.tobytes(), table.itemsize * table.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _vectors(state: DataFrame, dim: int) -> DataFrame:
    """id, v of a state, as arrays."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b.id, "v": list(_table(b.v, dim))})

    return state.select("id", "v").mapInPandas(run, "id bigint, v array<double>")


def _adam(v: np.ndarray, m: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One Adam step of the rows in ``at``, whose gradients add up where a row recurs."""
    order = np.argsort(at, kind="stable")
    first = np.nonzero(np.diff(at[order], prepend=-1))[0]
    if not len(first):
        return
    rows, g = at[order[first]], np.add.reduceat(grad[order], first, axis=0)
    t = n[rows] + 1
    n[rows] = t
    a = m[rows]
    a *= 0.9
    a += 0.1 * g
    m[rows] = a
    g *= g
    g *= 0.001
    b = s[rows]
    b *= 0.999
    b += g
    s[rows] = b
    b /= (1 - 0.999**t)[:, None]
    np.sqrt(b, out=b)
    b += 1e-8
    a *= (rate / (1 - 0.9**t))[:, None]
    a /= b
    v[rows] -= a


def _negatives(u: np.ndarray, known: np.ndarray, n_items: int, rng: np.random.Generator) -> np.ndarray:
    """An item that the user lacks for each u (-1 if it has all); known: sorted codes u * n_items + i of all pairs of the stratum."""
    drawn = rng.integers(0, n_items, len(u))
    has = lambda c: known[np.minimum(np.searchsorted(known, c), len(known) - 1)] == c
    open_ = np.nonzero(has(u * n_items + drawn))[0]
    for _ in range(16):
        if not len(open_):
            return drawn
        drawn[open_] = rng.integers(0, n_items, len(open_))
        open_ = open_[has(u[open_] * n_items + drawn[open_])]
    for k in open_:  # a user with nearly all items: one of those that it lacks
        mine = known[np.searchsorted(known, u[k] * n_items) : np.searchsorted(known, (u[k] + 1) * n_items)] - u[k] * n_items
        lacking = np.setdiff1d(np.arange(n_items), mine)
        drawn[k] = rng.choice(lacking) if len(lacking) else -1
    return drawn


def train(pairs: DataFrame, dim: int = 32, epochs: int = 100, patience: int = 8, held: float = 0.05, batch: int = 1_024, rate: float = 1e-3, l2: float = 1e-4, seed: int = 5, block: int = BLOCK) -> Factors:
    """Factors of distinct positive pairs (u, i: bigint). A pair is held out by its hash for the loss that ends the training when it has not
    fallen for ``patience`` epochs; with held 0 all epochs run. Pairs with a null are left out; without pairs there are no factors."""
    pairs = pairs.select(F.col("u").cast("bigint").alias("u"), F.col("i").cast("bigint").alias("i")).where("u IS NOT NULL AND i IS NOT NULL").distinct()
    is_held = F.pmod(F.xxhash64("u", "i", F.lit(seed)), F.lit(10_000)) < int(held * 10_000)
    pairs = materialize(pairs.withColumn("held", is_held), "pairs")
    users, items = pairs.select(F.col("u").alias("id")).distinct(), pairs.select(F.col("i").alias("id")).distinct()
    n_blocks = max(1, -(-max(users.count(), items.count()) // block))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    state = materialize(_start(users, 0, dim, seed).unionByName(_start(items, 1, dim, seed)), "factors")
    null = lambda kind: F.lit(None).cast(kind)
    known = pairs.select(of("u").alias("b"), of("i").alias("ib"), F.lit(2).alias("side"), F.col("u").alias("id"), F.col("i").alias("item"), "held", *[null("binary").alias(c) for c in "vms"], F.lit(0).alias("n"))
    best, losses = (None, state, 0), []
    for epoch in range(1, epochs + 1):
        total, count = 0.0, 0
        for shift in range(n_blocks):
            with_block = state.withColumn("item", F.lit(0).cast("bigint")).withColumn("held", F.lit(False))  # no null, or pandas makes floats of the ids
            with_block = with_block.withColumn("b", F.when(F.col("side") == 0, of("id")).otherwise(F.pmod(of("id") - shift, F.lit(n_blocks))).cast("int"))
            now = known.where(F.pmod(F.col("ib") - shift, F.lit(n_blocks)) == F.col("b")).drop("ib")

            def learn(pdf: pd.DataFrame) -> pd.DataFrame:  # runs before epoch and shift go on
                rows = [pdf[pdf.side == k] for k in (0, 1)]
                tables = [[_table(r[c], dim) for c in ("v", "m", "s")] + [r.n.to_numpy().astype(np.int64)] for r in rows]
                ids = [r.id.to_numpy() for r in rows]
                met = pdf[pdf.side == 2].sort_values("id", kind="stable")
                loss, n = 0.0, 0
                if len(met) and len(ids[1]):
                    order = [np.argsort(x) for x in ids]
                    is_out = met.held.to_numpy(bool)
                    items = met["item"].to_numpy(np.int64)
                    u = order[0][np.searchsorted(ids[0], met.id.to_numpy(), sorter=order[0])]
                    i = order[1][np.searchsorted(ids[1], items, sorter=order[1])]
                    codes = np.sort(u * len(ids[1]) + i)
                    rng = np.random.default_rng([seed, epoch, shift, int(pdf.b.iloc[0])])
                    (uv, um, us, un), (iv, im, is_, in_) = tables
                    out, kept = np.nonzero(is_out)[0], np.nonzero(~is_out)[0]
                    shuffled = rng.permutation(kept)
                    for lo in range(0, len(kept), batch):
                        k = shuffled[lo : lo + batch]
                        j = _negatives(u[k], codes, len(ids[1]), rng)
                        k, j = k[j >= 0], j[j >= 0]
                        a, p, q = uv[u[k]], iv[i[k]], iv[j]
                        g = -1 / (1 + np.exp(np.clip((a * (p - q)).sum(1), -50, 50)))[:, None] / max(1, len(k))
                        reg = 2 * l2 / max(1, len(k))
                        _adam(uv, um, us, un, u[k], g * (p - q) + reg * a, rate)
                        _adam(iv, im, is_, in_, np.concatenate([i[k], j]), np.concatenate([g * a + reg * p, -g * a + reg * q]), rate)
                    if len(out):
                        j = _negatives(u[out], codes, len(ids[1]), np.random.default_rng([seed, shift, int(pdf.b.iloc[0])]))
                        k, j = out[j >= 0], j[j >= 0]
                        loss, n = float(np.logaddexp(0, -(uv[u[k]] * (iv[i[k]] - iv[j])).sum(1)).sum()), len(k)
                parts = [pd.DataFrame({"side": np.int32(side), "id": ids[side], "v": _bytes(t[0]), "m": _bytes(t[1]), "s": _bytes(t[2]), "n": t[3].astype(np.int32), "loss": 0.0, "pairs": 0}) for side, t in enumerate(tables)]
                parts.append(pd.DataFrame({"side": [np.int32(3)], "id": [0], "v": [None], "m": [None], "s": [None], "n": [np.int32(0)], "loss": [loss], "pairs": [n]}))
                return pd.concat(parts, ignore_index=True)[[c.split()[0] for c in _OUT.split(", ")]]  # without a missing value, or ids become floats

            new = materialize(with_block.unionByName(now).groupBy("b").applyInPandas(learn, _OUT), "factors")
            row = new.where("side = 3").agg(F.sum("loss"), F.sum("pairs")).first()
            total, count = total + (row[0] or 0.0), count + (row[1] or 0)
            if state is not best[1]:
                discard(state)
            state = new.where("side < 2").select(*[c.split()[0] for c in _STATE.split(", ")])
        losses.append(total / count if count else float("nan"))
        if not count or best[0] is None or losses[-1] < best[0] - 1e-9:
            if best[1] is not state:
                discard(best[1])
            best = (losses[-1], state, epoch)
        elif epoch - best[2] >= patience:
            break
    side = lambda k: _vectors(best[1].where(F.col("side") == k), dim)
    return Factors(side(0), side(1), losses, best[2])


def sweep(pairs: DataFrame, dims: tuple[int, ...] = (32, 64), **options) -> tuple[int, Factors]:
    """(dim, factors): the dimension of the least held-out loss, trained again on all pairs for as many epochs as it took."""
    tried = [(min(f.losses, default=float("inf")), d, f.best_epoch) for d in dims for f in [train(pairs, d, **options)]]
    _, dim, epoch = min(tried)
    return dim, train(pairs, dim, **(options | {"epochs": max(1, epoch), "held": 0.0}))
