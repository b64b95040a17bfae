"""Learning to rank and matrix factorisation: features, pairs, losses, scaling, training and scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vitrine.functions import text as tx
from vitrine.operators import fusion as fu
from vitrine.operators import ranking as rk
from vitrine.plans.storage import materialize

# fixed values: the feature order is a contract of trained models
FEATURES = [
    "keyword_present", "semantic_present", "retrieval_source_count", "keyword_score", "semantic_score", "keyword_rr", "semantic_rr", "keyword_rank_fraction", "semantic_rank_fraction",
    "rrf_score", "weighted_score", "title_exact_phrase", "title_all_query_tokens", "title_overlap_count", "title_overlap_ratio", "brand_present", "brand_exact", "brand_overlap",
    "description_missing", "title_token_count", "description_token_count", "average_rating", "log_rating_count", "price_missing", "log_price",
]
FEATURE_VERSION = "rank-features-v1"


def features(df: DataFrame, depth: int) -> dict[str, Column]:
    """The 25 features from query, keyword_rank/_score, semantic_rank/_score, rrf_score, weighted_score and the product's columns."""
    q, t, b = tx.tokens(F.col("query")), tx.tokens(F.col("title")), tx.tokens(F.col("brand"))
    n = F.size(F.array_distinct(q))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    kw, se = F.col("keyword_rank"), F.col("semantic_rank")
    price = F.when(~F.isnan("price") & (F.col("price") > 0), F.col("price"))
    rating = F.when(~F.isnan("average_rating"), F.col("average_rating"))
    brand = tx.phrase(F.col("brand"))
    return {
        "keyword_present": flag(kw.isNotNull()),
        "semantic_present": flag(se.isNotNull()),
        "retrieval_source_count": flag(kw.isNotNull()) + flag(se.isNotNull()),
        "keyword_score": F.coalesce("keyword_score", F.lit(0.0)),
        "semantic_score": F.coalesce("semantic_score", F.lit(0.0)),
        "keyword_rr": F.coalesce(1.0 / kw, F.lit(0.0)),
        "semantic_rr": F.coalesce(1.0 / se, F.lit(0.0)),
        "keyword_rank_fraction": F.coalesce(kw / F.lit(float(depth)), F.lit(0.0)),
        "semantic_rank_fraction": F.coalesce(se / F.lit(float(depth)), F.lit(0.0)),
        "rrf_score": F.col("rrf_score"),
        "weighted_score": F.col("weighted_score"),
        "title_exact_phrase": flag(F.contains(tx.phrase(F.col("title")), tx.phrase(F.col("query")))),
        "title_all_query_tokens": flag((n > 0) & (tx.overlap_count(q, t) == n)),
        "title_overlap_count": tx.overlap_count(q, t).cast("double"),
        "title_overlap_ratio": tx.overlap_ratio(q, t),
        "brand_present": flag(F.size(b) > 0),
        "brand_exact": flag((F.size(b) > 0) & F.contains(tx.phrase(F.col("query")), brand)),
        "brand_overlap": tx.overlap_ratio(q, b),
        "description_missing": flag(F.coalesce(F.trim("description"), F.lit("")) == ""),
        "title_token_count": F.size(t).cast("double"),
        "description_token_count": F.size(tx.tokens(F.col("description"))).cast("double"),
        "average_rating": F.coalesce(rating, F.lit(0.0)),
        "log_rating_count": F.log1p(F.coalesce(F.col("rating_count").cast("double"), F.lit(0.0))),
        "price_missing": flag(price.isNull()),
        "log_price": F.coalesce(F.log1p(price), F.lit(0.0)),
    }


def scaler(df: DataFrame, names: list[str]) -> DataFrame:
    """name, mean, std (population; under 1e-8 counts as 1), one row per column, in one pass."""
    stats = df.agg(*[a for c in names for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in names]))
    return stats.select(e.alias("e")).select("e.*")


def scale(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns standardised by their own scaler (one row, broadcast)."""
    stats = df.agg(*[a for c in names for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    std = lambda c: F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}"))
    keep = [c for c in df.columns if c not in names]
    return df.crossJoin(F.broadcast(stats)).select(*keep, *[((F.col(c) - F.col(f"m_{c}")) / std(c)).alias(c) for c in names])


def hard_negative_pairs(df: DataFrame, query: str, item: str, position: str, label: str, n: int = 8) -> DataFrame:
    """query, positive, negative, negative_place: each positive with the query's n highest placed negatives (at most n rows per query)."""
    first = W.partitionBy(query).orderBy(position, item)
    neg = df.where(F.col(label) == 0).withColumn("negative_place", F.row_number().over(first)).where(F.col("negative_place") <= n)
    pos = df.where(F.col(label) > 0).select(query, F.col(item).alias("positive"))
    return pos.join(neg.select(query, F.col(item).alias("negative"), F.col("negative_place").cast("bigint").alias("negative_place")), query)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def grouped_split(df: DataFrame, source: str, shares: tuple[float, float] = (0.7, 0.15), seed: str = "split") -> DataFrame:
    """source, split of the distinct sources: in order of a seeded hash, 70 % train, 15 % validation, the rest test (counts half-even
    rounded). The order is numbered range by range, so no task orders all sources."""
    from vitrine.operators.numbering import dense_ids

    s = df.select(source).distinct().withColumn("_h", F.concat(F.sha2(F.concat(F.lit(seed), F.col(source).cast("string")), 256), F.col(source).cast("string")))
    numbered = dense_ids(s, "_h", "_i")
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    a, b = F.bround(F.col("_n") * shares[0], 0), F.bround(F.col("_n") * shares[1], 0)
    return numbered.crossJoin(F.broadcast(n)).select(source, F.when(F.col("_i") < a, "train").when(F.col("_i") < a + b, "validation").otherwise("test").alias("split"))


def linear(names: list[str], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for c, w in zip(names, weights):
        total = total + F.col(c) * F.lit(float(w))
    return total


class Mlp:
    """inputs -> hidden layers with ReLU -> 1, in NumPy; without hidden layers a linear model."""

    def __init__(self, inputs: int, hidden: tuple[int, ...] = (64, 32), seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 1]
        self.layers = [(rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None) -> list[np.ndarray]:
        """The values of all layers. ``mask`` (training only) multiplies the first hidden layer: 0 for dropped units, more than 1 for kept."""
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            z = np.maximum(z, 0) if i < len(self.layers) - 1 else z
            out.append(z * mask if i == 0 and mask is not None and len(self.layers) > 1 else z)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0]

    def gradients(self, acts: list[np.ndarray], d: np.ndarray, mask: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i in range(len(self.layers) - 1, -1, -1):
            out.append((acts[i].T @ d, d.sum(0)))
            if i:
                d = (d @ self.layers[i][0].T) * (acts[i] > 0)
                d = d * mask if i == 1 and mask is not None else d
        return out[::-1]


def train_ranknet(better: np.ndarray, worse: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 1e-3, patience: int = 5, seed: int = 3, hidden: tuple[int, ...] = (64, 32), dropout: float = 0.1) -> tuple[Mlp, list[float]]:
    """Fits the network so that better rows outscore worse ones (softplus of the negative margin, Adam), stopping when the loss on every
    tenth pair has not fallen for ``patience`` epochs. While training, a share ``dropout`` of the first hidden layer is dropped. Returns the
    best model and the losses."""
    rng = np.random.default_rng(seed)
    model, best, stale = Mlp(better.shape[1], hidden, seed), None, 0
    held = np.arange(len(better)) % 10 == 0
    if held.all() or len(better) < 10:
        held[:] = False
    moments = [(np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)) for w, b in model.layers]
    step, losses = 0, []
    for _ in range(epochs):
        order = rng.permutation(np.nonzero(~held)[0])
        for lo in range(0, len(order), batch):
            i = order[lo : lo + batch]
            ma, mb = (((rng.random((len(i), hidden[0])) >= dropout) / (1 - dropout) for _ in range(2)) if hidden and dropout else (None, None))
            fa, fb = model.forward(better[i], ma), model.forward(worse[i], mb)
            g = -1 / (1 + np.exp(np.clip(fa[-1] - fb[-1], -50, 50))) / len(i)
            ga, gb = model.gradients(fa, g, ma), model.gradients(fb, -g, mb)
            step += 1
            for j, ((w, b), (mw, vw, mb, vb)) in enumerate(zip(model.layers, moments)):
                for p, grad, m, v in ((w, ga[j][0] + gb[j][0], mw, vw), (b, ga[j][1] + gb[j][1], mb, vb)):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        check = held if held.any() else ~held
        margin = model.score(better[check]) - model.score(worse[check])
        losses.append(float(np.mean(np.logaddexp(0, -margin))))
        if best is None or losses[-1] < best[0] - 1e-9:
            best, stale = (losses[-1], [(w.copy(), b.copy()) for w, b in model.layers]), 0
        else:
            stale += 1
            if stale >= patience:
                break
    model.layers = best[1]
    return model, losses


#: Networks that are tried: a linear one, one hidden layer, two.
ARCHITECTURES = ((), (32,), (64, 32))


def choose_ranknet(better: np.ndarray, worse: np.ndarray, architectures: tuple[tuple[int, ...], ...] = ARCHITECTURES, **options) -> tuple[Mlp, list[float], tuple[int, ...]]:
    """The network of the least loss on the held-out pairs, its losses and its hidden layers; of equal ones the smaller."""
    tried = [(*train_ranknet(better, worse, hidden=h, **options), h) for h in architectures]
    return min(tried, key=lambda t: (round(min(t[1]), 9), sum(t[2])))


def candidate_features(channels: DataFrame, queries: DataFrame, products: DataFrame, depth: int) -> DataFrame:
    """The columns of ``queries`` (query_id, query and more), product_id, place (by fused rank) and FEATURES of every candidate of
    ``channels`` (query_id, product_id, channel, rank, score; channels keyword and semantic)."""
    cols = [a for c in ("keyword", "semantic") for a in (F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank"), F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"{c}_score"))]
    union = channels.groupBy("query_id", "product_id").agg(*cols)
    rrf = fu.rrf(channels, "query_id", "product_id").select("query_id", "product_id", F.col("score").alias("rrf_score"))
    w = fu.weighted(channels, "query_id", "product_id", {"keyword": 0.5, "semantic": 0.5}, renormalise=False).select("query_id", "product_id", F.col("score").alias("weighted_score"))
    p = products.select("product_id", "title", "brand", "description", "average_rating", "rating_count", "price")
    d = union.join(rrf, ["query_id", "product_id"]).join(w, ["query_id", "product_id"]).join(queries, "query_id").join(p, "product_id")
    d = rk.ranked(d, ["query_id"], "rrf_score", "product_id", "place")  # after the join, so that places have no gaps
    f = features(d, depth)
    return d.select(*queries.columns, "product_id", "place", *[f[c].alias(c) for c in FEATURES])


def score_with(df: DataFrame, names: list[str], model: Mlp) -> DataFrame:
    """df with ``score``: the model is shipped once per executor, rows are scored by Arrow batches."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=held.value.score(b[names].to_numpy(np.float64)))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def negatives(positives: DataFrame, n_items: DataFrame, user: str, item: str, epoch: int, tries: int = 8) -> DataFrame:
    """user, item, negative: for each positive pair an item index that the user does not have, drawn by hash from 0..n-1; the first valid of
    ``tries`` draws counts. A pair without one, of a user with most of the items, gets the r-th index that the user lacks, r drawn by hash
    too. A user who has every item is an error."""
    total = F.broadcast(n_items)
    draw = lambda t, n: F.pmod(F.xxhash64(F.lit(epoch), F.lit(t), F.col(user), F.col(item)), n)
    draws = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), draw(t, F.col("_n")).alias("negative")) for t in range(tries)]))
    drawn = positives.crossJoin(total).select(user, item, draws.alias("d")).select(user, item, "d.t", "d.negative")
    valid = drawn.join(positives.select(user, F.col(item).alias("negative")), [user, "negative"], "left_anti")
    found = materialize(valid.groupBy(user, item).agg(F.min_by("negative", "t").alias("negative")), "negatives")
    rest = materialize(positives.select(user, item).where(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct().join(found, [user, item], "left_anti"), "undrawn")
    # the user's j-th item (from 0) has item - j lacking indices before it, so the r-th lacking index is r plus the number of these up to r
    had = positives.join(rest.select(user).distinct(), user, "left_semi").crossJoin(total).where((F.col(item) >= 0) & (F.col(item) < F.col("_n"))).select(user, F.col(item).cast("bigint").alias("_i")).distinct()
    gaps = had.withColumn("_r", F.col("_i") - F.row_number().over(W.partitionBy(user).orderBy("_i")) + 1)
    lacking = rest.join(had.groupBy(user).agg(F.count(F.lit(1)).alias("_had")), user, "left").crossJoin(total).withColumn("_free", F.col("_n") - F.coalesce("_had", F.lit(0)))
    none = F.raise_error(F.concat(F.lit("user without an eligible negative item: "), F.col(user).cast("string"))).cast("bigint")
    wanted = lacking.select(user, F.col(item), F.when(F.col("_free") > 0, draw(tries, F.greatest(F.col("_free"), F.lit(1)))).otherwise(none).alias("_r"))
    both = gaps.select(user, F.lit(None).cast(positives.schema[item].dataType).alias(item), "_r", F.lit(1).alias("_gap")).unionByName(wanted.withColumn("_gap", F.lit(0)))
    # a range window counts the gaps of equal _r too
    before = F.sum("_gap").over(W.partitionBy(user).orderBy("_r").rangeBetween(W.unboundedPreceding, W.currentRow))
    late = both.withColumn("negative", F.col("_r") + before).where("_gap = 0").select(user, item, "negative")
    return found.unionByName(late)
