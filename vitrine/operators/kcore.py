"""Iterative k-core of the user-item graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.plans.storage import discard, materialize


def k_core(pairs: DataFrame, k_user: int, k_item: int, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """Distinct pairs whose users keep k_user items and items k_item users, dropping both at once until nothing changes. Degrees are
    aggregated, so a hot user or item combines on the map side. Each round is written to the shared folder; only counts come back."""
    now = materialize(pairs.select(user, item).distinct(), "core")
    n = now.count()
    while True:
        users = now.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < k_user).select(user)
        items = now.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < k_item).select(item)
        before, now = now, materialize(now.join(users, user, "left_anti").join(items, item, "left_anti"), "core")
        left = now.count()
        discard(before)
        if left == n:
            return now
        n = left
