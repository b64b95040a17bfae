"""Items that occur together in baskets, and how much more often than by chance.

A basket's items are kept in chunks of about CHUNK items. Most baskets are one chunk and yield their pairs at once; a huge basket has many
chunks, whose pairs of chunks are distributed over tasks by (basket, chunk, chunk), so no task ever holds a whole huge basket. Items that
can be in no wanted pair (too rare for the least count, or too frequent for the least ratio) are dropped before pairs are made: that
loses no pair, since a pair occurs no more often than its rarer item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.plans.storage import materialize

CHUNK = 128
#: Parts that the items of a basket are spread over while they are joined with facts about the basket.
SALTS = 32
MAX_HOT = 1_000


def baskets(events: DataFrame, user: str, item: str, day: Column) -> DataFrame:
    """owner, day, item: each item of a basket once. Rows without user, item or day are in no basket; '' is an item like any other."""
    rows = events.select(F.col(user).alias("owner"), F.col(item).alias("item"), day.alias("day"))
    return rows.where(F.col("owner").isNotNull() & F.col("item").isNotNull() & F.col("day").isNotNull()).distinct()


def _chunks(rows: DataFrame) -> DataFrame:
    """owner, day, n_chunks, chunk, items (sorted array of struct<item, n>) with about CHUNK items each."""
    sizes = rows.groupBy("owner", "day").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK)
    # few baskets are that large; they are repeated for each salt so that a basket with a third of all rows is joined by many tasks
    big = sizes.select("owner", "day", F.ceil(F.col("size") / CHUNK).cast("int").alias("n_chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")).join(big, ["owner", "day", "salt"], "left")
    chunk = F.when(F.col("n_chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("chunk"), "item"), F.col("n_chunks"))).cast("int")
    marked = spread.select("owner", "day", F.coalesce("n_chunks", F.lit(1)).alias("n_chunks"), chunk.alias("chunk"), F.struct("item", "n").alias("i"))
    return marked.groupBy("owner", "day", "n_chunks", "chunk").agg(F.sort_array(F.collect_list("i")).alias("items"))


def _pairs(left: Column, right: Column, same: Column) -> Column:
    """(smaller item, larger item) of two chunks; within one chunk each pair once."""
    def of(x: Column, i: Column) -> Column:
        others = F.when(same, F.slice(right, i + 2, F.size(right))).otherwise(right)
        return F.transform(others, lambda y: F.when(x["item"] < y["item"], F.struct(x.alias("a"), y.alias("b"))).otherwise(F.struct(y.alias("a"), x.alias("b"))))

    return F.flatten(F.transform(left, of))


def pair_counts(rows: DataFrame, n_baskets: DataFrame, min_count: int, min_ratio: float) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b, ratio of all pairs with n_ab >= min_count and ratio = n_ab * N / (n_a * n_b) >= min_ratio.

    ``rows`` as of baskets(); ``n_baskets``: one row, all_baskets (N). With min_count 1 and min_ratio 0 nothing is dropped.
    """
    total = F.broadcast(n_baskets.select(F.col("all_baskets").cast("double").alias("all_baskets")))  # one row
    items = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # ratio <= N / max(n_a, n_b), because n_ab <= min(n_a, n_b)
    able = items.where(F.col("n") >= min_count).crossJoin(total).where(F.col("n") * F.lit(float(min_ratio)) <= F.col("all_baskets")).select("item", "n")
    # what is too frequent goes first, by itself: at most min_ratio times the mean basket size items, so that no hot item is shuffled
    frequent = items.crossJoin(total).where(F.col("n") * F.lit(float(min_ratio)) > F.col("all_baskets")).select("item")
    kept = rows.join(F.broadcast(frequent), "item", "left_anti") if min_ratio >= 1 else rows  # below 1 no item is too frequent
    # an item with at least 1/MAX_HOT of the rows gets its count by broadcast, of at most MAX_HOT rows; the rest are joined by shuffle
    all_rows = F.broadcast(items.agg(F.sum("n").alias("all_rows")))
    able = able.crossJoin(all_rows).select("item", "n", (F.col("n") * MAX_HOT >= F.col("all_rows")).alias("hot"))
    hot = F.broadcast(able.where("hot").select("item", "n"))
    counted = kept.join(hot, "item").unionByName(kept.join(hot.select("item"), "item", "left_anti").join(able.where("NOT hot").select("item", "n"), "item"))
    chunks = materialize(_chunks(counted), "chunks")
    # within a chunk
    inner = chunks.where(F.size("items") > 1).select(F.explode(_pairs(F.col("items"), F.col("items"), F.lit(True))).alias("p"))
    # between chunks of a basket: each chunk meets the others under the key of their pair
    many = chunks.where(F.col("n_chunks") > 1)
    each = many.select("owner", "day", "chunk", "items", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("other")).where(F.col("other") != F.col("chunk"))
    low = each.where(F.col("chunk") < F.col("other")).select("owner", "day", F.col("chunk").alias("lo"), F.col("other").alias("hi"), F.col("items").alias("left"))
    high = each.where(F.col("chunk") > F.col("other")).select("owner", "day", F.col("other").alias("lo"), F.col("chunk").alias("hi"), F.col("items").alias("right"))
    outer = low.join(high, ["owner", "day", "lo", "hi"]).select(F.explode(_pairs(F.col("left"), F.col("right"), F.lit(False))).alias("p"))
    counted = inner.unionByName(outer).groupBy(F.col("p.a.item").alias("item_a"), F.col("p.b.item").alias("item_b")).agg(F.count(F.lit(1)).alias("n_ab"), F.max("p.a.n").alias("n_a"), F.max("p.b.n").alias("n_b"))
    ratio = F.col("n_ab") * F.col("all_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return counted.where(F.col("n_ab") >= min_count).crossJoin(total).withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio).drop("all_baskets")


def together(events: DataFrame, user: str, item: str, day: Column, min_count: int, min_ratio: float) -> DataFrame:
    """pair_counts() of the baskets in ``events``; N counts all baskets, those of one item too."""
    rows = materialize(baskets(events, user, item, day), "baskets")
    n = rows.select("owner", "day").distinct().agg(F.count(F.lit(1)).alias("all_baskets"))
    return pair_counts(rows, n, min_count, min_ratio)
