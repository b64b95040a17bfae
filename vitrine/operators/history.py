"""User histories: latest and first occurrences, hold-out splits and restrictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pairs(events: DataFrame, user: str = "user_id", item: str = "product_id") -> DataFrame:
    return events.select(user, item).distinct()


def last_seen(events: DataFrame, user: str = "user_id", item: str = "product_id", at: str = "occurred_at") -> DataFrame:
    """user, item, at of the latest event of each pair."""
    return events.groupBy(user, item).agg(F.max(at).alias(at))


def first_seen_order(events: DataFrame, user: str = "user_id", item: str = "product_id", at: str = "occurred_at", key: str = "interaction_id") -> DataFrame:
    """Distinct items of a user numbered by their first event (time, then id)."""
    first = events.groupBy(user, item).agg(F.min(F.struct(at, key)).alias("f"))
    return first.withColumn("position", F.row_number().over(W.partitionBy(user).orderBy("f")).cast("bigint")).drop("f")


def leave_last(events: DataFrame, user: str = "user_id", item: str = "product_id", at: str = "occurred_at") -> DataFrame:
    """user, item, at, split: of each user with two items or more the last (ties: larger item) is test, the rest train. The last is found
    by aggregation, so a user with very many events costs no task more than their distinct items."""
    seen = last_seen(events, user, item, at)
    last = seen.groupBy(user).agg(F.max(F.struct(at, item)).alias("l"), F.count(F.lit(1)).alias("n")).where("n >= 2").select(user, F.col(f"l.{item}").alias("_last"))
    return seen.join(last, user).withColumn("split", F.when(F.col(item) == F.col("_last"), "test").otherwise("train")).drop("_last")


def inner_split(split: DataFrame, user: str = "user_id", item: str = "product_id", at: str = "occurred_at") -> DataFrame:
    """The last train item of users with two train items or more becomes validation."""
    train = split.where("split = 'train'").drop("split")
    again = leave_last(train, user, item, at).withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    single = train.join(again.select(user).distinct(), user, "left_anti").withColumn("split", F.lit("train"))
    return again.unionByName(single)


def history_bin(n):
    """'<=1', '2-4' or '>=5'."""
    return F.when(n <= 1, "<=1").when(n <= 4, "2-4").otherwise(">=5")


def degree_bin(n):
    """'0', '1' or '2+'."""
    return F.when(n == 0, "0").when(n == 1, "1").otherwise("2+")
