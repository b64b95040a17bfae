"""Recommendations for many users at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators import blocks as bl
from vitrine.operators import vectors as ve
from vitrine.operators.fusion import K0
from vitrine.operators.numbering import dense_ids
from vitrine.plans.storage import materialize, write_parts

#: Parts over which the users that want one place are spread.
SALTS = 64


def profiles(history: DataFrame, vectors: DataFrame, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """user, v: the unit mean of the vectors of a user's distinct items; users without any have no row."""
    return ve.mean_vector(history.select(user, item).distinct().join(vectors.select(item, "v"), item), user)


def vector_recs(users: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """user, item, score, rank: the k best unseen items of each user by inner product."""
    return ve.exact_top_k(users, vectors, k, user, item, "v", seen)


def popular_places(counts: DataFrame, item: str = "product_id") -> DataFrame:
    """item, n, place: 1-based place by count descending, identifier ascending; numbered range by range."""
    keyed = counts.withColumn("_k", F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.lit(" "), F.col(item)))
    return dense_ids(keyed, "_k", "_p").select(item, "n", (F.col("_p") + 1).cast("bigint").alias("place"))


def wanted_places(users: DataFrame, seen: DataFrame, places: DataFrame, k: int, user: str, item: str) -> tuple[DataFrame, int]:
    """(user, _w: the k first places that a user has not seen; the last place that any user wants)."""
    had = seen.select(user, item).distinct().join(places.select(item, "place"), item).groupBy(user).agg(F.array_sort(F.collect_list("place")).alias("_s"))
    u = users.select(user).distinct().join(had, user, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<bigint>")))
    # a seen place counts only if it lies within k plus the seen places before it
    within = F.filter(F.transform("_s", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"] <= x["i"] + k)
    near = u.select(user, F.transform(within, lambda x: x["p"]).alias("_s"))
    wanted = F.slice(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.size("_s").cast("bigint") + k), F.col("_s")), 1, k)
    return near.select(user, wanted.alias("_w")), k + (near.agg(F.max(F.size("_s"))).first()[0] or 0)


def popular_unseen(users: DataFrame, seen: DataFrame, places: DataFrame, k: int, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """user, item, n, rank: the k most popular items that a user has not seen. Users are not crossed with items: the places 1..k plus the
    number of seen places, without the seen ones, are the wanted places, and these are joined with the items."""
    wanted, most = wanted_places(users, seen, places, k, user, item)
    rows = wanted.select(user, F.posexplode("_w").alias("_i", "place"))
    # a place is wanted by nearly every user, so the places go out by salt and no task holds all users of one
    salted = rows.withColumn("_t", F.pmod(F.xxhash64(user), F.lit(SALTS)).cast("int"))
    top = places.where(F.col("place") <= most).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(top, ["place", "_t"]).select(user, item, "n", (F.col("_i") + 1).cast("bigint").alias("rank"))


def hidden_ranks(train: DataFrame, hidden: DataFrame, vectors: DataFrame, methods: Sequence[str], weights: dict[str, float], k: int, views: dict[str, tuple[slice, slice]], counts: DataFrame | None = None, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """user, method, rank of each user's hidden item in the list of each method; null where the list lacks it.

    Lists hold the k best unseen items: those of ``views`` by the product of a slice of the user's profile with a slice of the item's vector,
    "popularity" by ``counts`` (item, n), "weighted" and "rrf" by fusion of all of these. Whoever asks for the rank of one item needs no lists
    to leave the task that makes them: of each user only the train items, the wanted places and the hidden item are shuffled, as numbers.
    """
    fuse = bool({"weighted", "rrf"} & set(methods))
    popular = fuse or "popularity" in methods
    v = vectors.select(item, F.col("v").cast("array<double>").alias("v"))
    names = v.select(item)
    if popular:
        places = materialize(popular_places(counts, item), "places")
        names = names.unionByName(places.select(item)).distinct()
    numbers = materialize(dense_ids(names, item, "pos"), "numbers")
    there = bl.write_items(v.join(numbers, item), item, ve.BLOCK)
    known = train.select(user, item).distinct().join(numbers, item)
    seen = known.groupBy(user).agg(F.collect_list("pos").alias("_s"))
    asked = hidden.select(user, item).join(numbers, item, "left").select(user, F.coalesce("pos", F.lit(-2)).alias("_h"))
    asked = asked.join(seen, user, "left")
    if popular:
        wanted, most = wanted_places(hidden, train, places, k, user, item)
        asked = asked.join(wanted, user, "left")
        top = places.where(F.col("place") <= most).join(numbers, item, "left").select("place", F.coalesce("pos", F.lit(-1)).alias("pos"), "n")  # a null item keeps its place
        folder = write_parts(top.withColumn("part", F.floor((F.col("place") - 1) / ve.BLOCK).cast("int")), "part", "places")
    else:
        asked = asked.withColumn("_w", F.lit(None).cast("array<bigint>"))
    asked = materialize(asked, "asked")

    def places_of() -> tuple[np.ndarray, np.ndarray]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        t = pyarrow.parquet.read_table(path, filesystem=files, columns=["place", "pos", "n"])
        order = np.argsort(t["place"].to_numpy())
        return t["pos"].to_numpy()[order], t["n"].to_numpy()[order].astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_place = places_of() if popular else None
        for b in bl.batches_of(batches, bl.QUERIES):
            had, target = bl.Pairs.of(b["_s"]), b["_h"].to_numpy(np.int64)
            mean, some = bl.means(there, had, len(b))
            use = np.nonzero(some)[0]
            of = np.full(len(b), -1)
            of[use] = np.arange(len(use))
            mine = some[had.rows]
            tops = {name: (bl.Best(np.ascontiguousarray(mean[use][:, q]), k), i) for name, (q, i) in views.items() if fuse or name in methods}
            if len(use):
                bl.search(there, list(tops.values()), bl.Pairs(of[had.rows[mine]], had.pos[mine]))
            lists = {}
            for name, (best, _) in tops.items():
                row, pos, score, rank = best.kept()
                lists[name] = (use[row], pos, score, rank)
            if popular:
                want = [np.zeros(0, np.int64) if w is None else np.asarray(w, np.int64) for w in b["_w"]]
                row, place = np.repeat(np.arange(len(b)), [len(w) for w in want]), np.concatenate([np.zeros(0, np.int64), *want])
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                held = place <= len(at_place[0])  # a small catalogue has fewer places than are wanted
                row, place, rank = row[held], place[held], rank[held]
                lists["popularity"] = (row, at_place[0][place - 1], at_place[1][place - 1], rank)
            found = {name: (row, pos, rank) for name, (row, pos, _, rank) in lists.items()}
            if "weighted" in methods:
                found["weighted"] = bl.weighted([(*lists[c][:3], w) for c, w in weights.items() if c in lists], len(b))
            if "rrf" in methods:
                row, pos, _, rank = (np.concatenate(c) for c in zip(*lists.values()))
                found["rrf"] = bl.fused(row, pos, 1.0 / (K0 + rank))
            for m in methods:
                row, pos, rank = found[m]
                hit = pos == target[row]
                out = np.zeros(len(b), np.int64)
                out[row[hit]] = rank[hit]
                yield pd.DataFrame({user: b[user], "method": m, "rank": out})

    ranks = bl.spread(asked, user).mapInPandas(run, T.StructType([hidden.schema[user], T.StructField("method", T.StringType()), T.StructField("rank", T.LongType())]))
    return ranks.withColumn("rank", F.nullif("rank", F.lit(0)))
