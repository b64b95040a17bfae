"""Unit vectors, exact nearest neighbours in blocks, hyperplane hashing and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators import blocks as bl
from vitrine.operators.numbering import dense_ids
from vitrine.operators.ranking import ranked
from vitrine.plans.storage import materialize
#: Items of a block in the shared folder.
BLOCK = 16_384


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its norm (at least 1e-12) as doubles."""
    # the one-element array binds the norm once for all elements
    bound = F.transform(F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n"))), lambda p: F.transform(p["v"], lambda x: x.cast("double") / p["n"]))
    return F.get(bound, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dim: int = 64) -> Column:
    """dim finite elements that are not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "product_id", vector: str = "v", seen: DataFrame | None = None) -> DataFrame:
    """query, item, score, rank: the k items of the largest inner product with each query, ties by identifier, without the pairs (query, item)
    in ``seen``.

    Each task holds some queries and reads the blocks of items from the shared folder one after the other. Nothing is broadcast or copied, and
    the result does not depend on the number of blocks.
    """
    items = materialize(dense_ids(items.select(item, F.col(vector).cast("array<double>").alias(vector)), item, "pos"), "items")
    there = bl.write_items(items, item, BLOCK, vector)
    queries = queries.select(query, F.col(vector).cast("array<double>").alias(vector))
    if seen is not None:
        had = seen.select(query, item).distinct().join(items.select(item, "pos"), item).groupBy(query).agg(F.collect_list("pos").alias("_s"))
        queries = queries.join(had, query, "left")
    else:
        queries = queries.withColumn("_s", F.lit(None).cast("array<bigint>"))
    queries = materialize(queries, "queries")
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in bl.batches_of(batches, bl.QUERIES):
            if not there.blocks:
                return
            best = bl.Best(np.stack(b[vector].to_numpy()).astype(np.float64), k)
            bl.search(there, [(best, slice(None))], bl.Pairs.of(b["_s"]))
            row, pos, score, rank = best.kept()
            yield pd.DataFrame({query: pd.Series(b[query].to_numpy()[row]), item: pd.Series(there.ids(pos).tolist(), dtype=object), "score": score, "rank": rank})

    return bl.spread(queries, query).mapInPandas(run, schema)


#: Vectors that centroids are fitted on, at most; centroids, at most; entries of a list that one task takes.
SAMPLE, LISTS, PART = 50_000, 4_096, 32_768


def centroids(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """n unit centroids of unit vectors by spherical k-means from random rows; a centroid without members keeps its place."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        for d in range(c.shape[1]):
            total = np.bincount(near, sample[:, d], len(c))
            c[:, d] = np.where(np.bincount(near, minlength=len(c)) > 0, total, c[:, d])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def ivf_top_k(queries: DataFrame, items: DataFrame, k: int, share: float = 0.12, query: str = "query_id", item: str = "product_id", vector: str = "v") -> DataFrame:
    """query, item, score, rank of the k best items in the lists nearest to each query: an inverted file of unit vectors.

    Centroids, twice the root of the number of items and at most LISTS, are fitted on at most SAMPLE items; every item is in the list of its
    nearest centroid. A query looks into the nearest ``share`` of the lists. A query goes only to lists that it looks into, an item only to
    its own; a list of more than PART items is cut into parts by hash, and queries go to each. Empty queries or items give no rows.
    """
    items = materialize(items.select(item, vector), "items")
    n = items.count()
    drawn = items.where(F.pmod(F.xxhash64(item), F.lit(1 << 20)) < int(min(1.0, 1.3 * SAMPLE / max(n, 1)) * (1 << 20)) + 1).select(vector).limit(SAMPLE).toPandas()[vector]
    if not len(drawn):
        drawn = items.select(vector).limit(1).toPandas()[vector]
    types = [T.StructField(query, queries.schema[query].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("score", T.DoubleType())]
    if not len(drawn):
        return items.sparkSession.createDataFrame([], T.StructType([*types, T.StructField("rank", T.LongType())]))
    c = items.sparkSession.sparkContext.broadcast(centroids(np.stack(drawn.to_numpy()).astype(np.float64), max(1, min(LISTS, int(2 * n**0.5)))))
    probes = max(1, round(share * len(c.value)))

    def to_lists(key: str, many: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.stack(b[vector].to_numpy()).astype(np.float64) @ c.value.T
                    at = np.argpartition(-near, many - 1, axis=1)[:, :many] if many < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(b), 1))
                    yield pd.DataFrame({key: pd.Series(b[key].tolist(), dtype=object), vector: b[vector].tolist(), "_l": at.astype(np.int32).tolist()})

        return run

    listed = lambda df, key, many: df.select(key, vector).mapInPandas(to_lists(key, many), T.StructType([df.schema[key], T.StructField(vector, T.ArrayType(T.DoubleType())), T.StructField("_l", T.ArrayType(T.IntegerType()))])).select(key, vector, F.explode("_l").alias("_l"))
    as_double = lambda df: df.withColumn(vector, F.col(vector).cast("array<double>"))
    i = materialize(listed(as_double(items), item, 1), "lists")
    parts = i.groupBy("_l").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_n"))  # at most LISTS rows
    i = i.join(F.broadcast(parts), "_l").withColumn("_p", F.pmod(F.xxhash64(item), F.col("_n")).cast("int")).drop("_n")
    q = listed(as_double(queries), query, probes).join(F.broadcast(parts), "_l").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return a[[query]].iloc[:0].assign(**{item: b[item].iloc[:0].to_numpy(object), "score": np.zeros(0)})
        x, y = np.stack(a[vector].to_numpy()), np.stack(b[vector].to_numpy())
        which, where, score = [], [], []
        for lo in range(0, len(x), 512):
            s = x[lo : lo + 512] @ y.T
            least = np.partition(s, len(y) - k, axis=1)[:, len(y) - k] if k < len(y) else np.full(len(s), -np.inf)
            r, at = np.nonzero(s >= least[:, None] - 1e-9)
            which.append(lo + r)
            where.append(at)
            score.append(s[r, at])
        left, right = a[query].to_numpy(object)[np.concatenate(which)], b[item].to_numpy(object)[np.concatenate(where)]
        return pd.DataFrame({query: pd.Series(left, dtype=object), item: pd.Series(right, dtype=object), "score": np.concatenate(score)})

    found = q.groupBy("_l", "_p").cogroup(i.groupBy("_l", "_p")).applyInPandas(multiply, T.StructType(types))
    return ranked(found.withColumn("score", F.round("score", 9)), [query], "score", item).where(F.col("rank") <= k)


def planes(n: int, dim: int, seed: int = 11) -> list[list[float]]:
    """n fixed random hyperplanes through the origin."""
    rng = np.random.default_rng(seed)
    return [[round(float(x), 6) for x in row] for row in rng.standard_normal((n, dim))]


def bucket(v: Column, normals: list[list[float]]) -> Column:
    """The bits of the sides of the hyperplanes as a bigint."""
    bits = [F.when(dot(v, F.array(*[F.lit(x) for x in p])) >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(normals)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total.cast("bigint")


def probed_buckets(v: Column, normals: list[list[float]], probes: int) -> Column:
    """The ``probes`` buckets nearest to the vector, its own first: of the sides that are flipped, the squared margins add up to the least."""
    margins = F.array(*[dot(v, F.array(*[F.lit(x) for x in p])) for p in normals])
    # the one-element array binds margins and own bucket once for all flips
    bound = F.array(F.struct(margins.alias("m"), bucket(v, normals).alias("b")))

    def nearest(p: Column) -> Column:
        cost = lambda flip: sum((F.when(flip.bitwiseAND(F.lit(1 << i)) != 0, F.get(p["m"], F.lit(i)) * F.get(p["m"], F.lit(i))).otherwise(0.0) for i in range(len(normals))), F.lit(0.0))
        flips = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << len(normals)) - 1).cast("bigint")), lambda f: F.struct(cost(f).alias("cost"), f.alias("flip")))
        return F.transform(F.slice(F.array_sort(flips), 1, probes), lambda f: p["b"].bitwiseXOR(f["flip"]))

    return F.get(F.transform(bound, nearest), F.lit(0))


def lsh_top_k(queries: DataFrame, items: DataFrame, k: int, tables: list[list[list[float]]], query: str = "query_id", item: str = "product_id", vector: str = "v", probes: int = 1) -> DataFrame:
    """query, item, score, rank among the items that lie in one of the query's ``probes`` nearest buckets in any table (multi-table probing;
    with 1 its own bucket alone). A pair is scored in the first table in which it meets, so no vectors are shuffled to drop repeats."""
    own = lambda p: F.array(bucket(F.col(vector), p)) if probes == 1 else probed_buckets(F.col(vector), p, probes)
    q = queries.select(query, F.col(vector), F.array(*[own(p) for p in tables]).alias("_qb"))
    i = items.select(item, F.col(vector).alias("_w"), F.array(*[bucket(F.col(vector), p) for p in tables]).alias("_ib"))
    q = q.select("*", F.posexplode("_qb").alias("t", "_at")).select(query, vector, "_qb", "t", F.explode("_at").alias("b"))
    i = i.select("*", F.posexplode("_ib").alias("t", "b"))
    met_before = F.lit(False)
    for t in range(len(tables) - 1):
        met_before = met_before | ((F.col("t") > t) & F.array_contains(F.get("_qb", F.lit(t)), F.get("_ib", F.lit(t))))
    met = q.join(i, ["t", "b"]).where(~met_before)
    scored = met.select(query, item, F.round(dot(F.col(vector), F.col("_w")), 9).alias("score"))
    return ranked(scored, [query], "score", item).where(F.col("rank") <= k)


def mean_vector(rows: DataFrame, key: str, vector: str = "v", dim: int = 64) -> DataFrame:
    """key, v: the unit mean of the key's vectors; a mean of norm under 1e-12 has no row. Sums of elements combine on the map side."""
    sums = rows.groupBy(key).agg(*[F.sum(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)], F.count(F.lit(1)).alias("_n"))
    mean = sums.select(key, F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)]).alias("v"))
    return mean.where(norm(F.col("v")) >= 1e-12).select(key, unit(F.col("v")).alias("v"))


def recall(found: DataFrame, exact: DataFrame, k: int, query: str = "query_id", item: str = "product_id") -> DataFrame:
    """query, recall: the share of the k exact neighbours that were found; 0 if there are none."""
    hit = exact.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select(query, item, F.lit(1).alias("_hit")), [query, item], "left")
    return hit.groupBy(query).agg((F.count("_hit") / F.lit(float(k))).alias("recall"))
