"""One wide row per entity from long event rows.

State per entity is a sparse vector: an array of (type index, count, total, latest) with one entry per type that occurred. States are
mergeable (``merge_states``), so days or sources can be kept apart and added up; columns are made only at the end (``expand``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event types are column names in the end, so their number is bounded by what a row can hold.
MAX_TYPES = 5_000
#: A value beyond this is a recording error and not added up.
MAX_VALUE = 1e6
UNLISTED = "unlisted"
#: Entities that are expanded at a time.
ROWS_AT_ONCE = 1_024


def distinct_events(df: DataFrame, entity: str, item: str, kind: str, occurred: str, value: str) -> DataFrame:
    """Each event once: rows that agree in entity, item, kind and time are one delivery repeated. Columns entity, kind, at, amount.

    The amount is the largest valid one of the repeats; null, NaN, infinite, negative and absurd values (above MAX_VALUE) are not valid and
    give null. Rows without entity are left out; null item, kind or time are values of their own. The grouping is on the whole event, so
    an entity with a third of all rows is spread over all tasks.
    """
    v = F.col("_v")
    valid = F.when(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= MAX_VALUE), v)
    rows = df.select(F.col(entity).alias("entity"), F.col(item).alias("item"), F.col(kind).alias("kind"), F.col(occurred).alias("at"), F.col(value).cast("double").alias("_v"))
    return rows.where(F.col("entity").isNotNull()).groupBy("entity", "item", "kind", "at").agg(F.max(valid).alias("amount")).select("entity", "kind", "at", "amount")


def sparse_states(events: DataFrame, types: list[str]) -> DataFrame:
    """entity, state array<struct<idx int, n bigint, total double, latest timestamp>> of distinct_events(). Kinds that are not in
    ``types`` (null too) share the index len(types)."""
    index = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))]) if types else F.lit(None).cast("map<string,int>")
    kinds = events.withColumn("idx", F.coalesce(F.try_element_at(index, F.coalesce(F.col("kind"), F.lit(""))), F.lit(len(types))))
    cells = kinds.groupBy("entity", "idx").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"), F.max("at").alias("latest"))
    return cells.groupBy("entity").agg(F.collect_list(F.struct("idx", "n", "total", "latest")).alias("state"))


def merge_states(*parts: DataFrame) -> DataFrame:
    """States of disjoint sets of events added up. Associative and commutative; an entity's state never exceeds one entry per type."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    cells = union.select("entity", F.explode("state").alias("c")).select("entity", "c.*")
    cells = cells.groupBy("entity", "idx").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest"))
    return cells.groupBy("entity").agg(F.collect_list(F.struct("idx", "n", "total", "latest")).alias("state"))


def column_names(types: list[str]) -> list[str]:
    """Column stems of the types: other characters than letters, digits and _ become _, a clash gets its index appended."""
    names: list[str] = []
    for i, t in enumerate(types):
        stem = re.sub(r"\W", "_", t, flags=re.ASCII) or "blank"
        names.append(f"{stem}_{i}" if stem in names or stem == UNLISTED else stem)
    return names


def expand(states: DataFrame, types: list[str], entity: str) -> DataFrame:
    """entity plus <type>_n (0 if none), <type>_total (0.0 if none) and <type>_latest_us (microseconds, null if none) for each type and
    for ``unlisted``, the kinds outside the list."""
    n_types = len(types) + 1
    stems = [*column_names(types), UNLISTED]
    fields = [T.StructField(entity, states.schema["entity"].dataType)]
    for stem in stems:
        fields += [T.StructField(f"{stem}_n", T.LongType()), T.StructField(f"{stem}_total", T.DoubleType()), T.StructField(f"{stem}_latest_us", T.LongType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                idx, n, total, latest = part.column(1).flatten().flatten()
                at = (idx.to_numpy(), row)
                counts, sums, last = (np.zeros((n_types, part.num_rows), t) for t in (np.int64, np.float64, np.int64))
                never = np.ones((n_types, part.num_rows), bool)
                counts[at] = n.to_numpy()
                sums[at] = np.round(total.to_numpy(), 4)
                last[at] = latest.fill_null(0).to_numpy()
                never[at] = latest.is_null().to_numpy(zero_copy_only=False)
                columns = [a for i in range(n_types) for a in (pa.array(counts[i]), pa.array(sums[i]), pa.array(last[i], mask=never[i]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    cells = F.transform("state", lambda c: F.struct(c["idx"].alias("idx"), c["n"].cast("bigint").alias("n"), c["total"].alias("total"), F.unix_micros(c["latest"]).alias("us")))
    return states.select("entity", cells.alias("c")).mapInArrow(run, T.StructType(fields))


def known_types(event_types: DataFrame, column: str = "event_type") -> list[str]:
    """The sorted distinct type names, which become columns; more than MAX_TYPES is an error."""
    rows = event_types.select(F.col(column)).where(F.col(column).isNotNull()).distinct().limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted(r[0] for r in rows)


def feature_table(events: DataFrame, types: list[str], entity: str = "user_id", item: str = "product_id", kind: str = "event_type", occurred: str = "occurred_at", value: str = "event_value") -> DataFrame:
    """One row per non-null entity of ``events`` with count, total and latest time for every type. See the parts above."""
    return expand(sparse_states(distinct_events(events, entity, item, kind, occurred, value), types), types, entity)
