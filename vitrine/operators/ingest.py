"""Idempotent loading: upserts, insert-or-ignore, bounds and the report of a load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The upserted table: of each key the incoming row with the largest ``order``, else the existing row. Columns in ``keep`` stay as they
    were where the key existed. One shuffle on the key."""
    cols = existing.columns
    both = existing.select(*cols, F.lit(0).alias("_in"), F.lit(None).cast("string").alias("_o")).unionByName(incoming.select(*cols, F.lit(1).alias("_in"), order.cast("string").alias("_o")))
    last = F.max_by(F.struct(*cols), F.struct("_in", "_o"))
    old = F.max(F.when(F.col("_in") == 0, F.struct(*cols)))
    merged = both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(last.alias("n"), old.alias("o"))
    return merged.select(*[F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) if c in keep else F.col(f"n.{c}").alias(c) for c in cols])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` lacks, each key once. Null keys never equal another row."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def widen_bounds(existing: DataFrame, seen: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """key, first, last with the smaller first and the larger last of both; unknown bounds yield to known ones."""
    both = existing.select(key, first, last).unionByName(seen.select(key, first, last))
    return both.groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that comes first in the given input order."""
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def route_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reason."""
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
