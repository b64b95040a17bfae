"""References to records that do not exist at their time.

A reference is an orphan if its key has no record, or if it happened before the record was created or once it was removed.

References are added up per source, key and month with their first and last time. Keys with at least 1/MAX_HOT of the references are judged
by a broadcast of their few records, all others by a shuffle join on the key, and both results are added. A group that lies wholly inside
or outside its record's life is settled by that; only groups that a birth or a removal cuts through are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.times import utc_month
from vitrine.plans.storage import materialize

#: At most so many keys are judged by broadcast (key, two timestamps and a flag each: under 1 MB).
MAX_HOT = 1_000


def references(df: DataFrame, source: str, record: str, key: str, occurred: str) -> DataFrame:
    """source, record_id, key, at. Null and empty keys are no references and have no row."""
    rows = df.select(F.lit(source).alias("source"), F.col(record).alias("record_id"), F.col(key).alias("key"), F.col(occurred).alias("at"))
    return rows.where(F.col("key").isNotNull() & (F.col("key") != ""))


def lifetimes(records: DataFrame, key: str, created: str, removed: str) -> DataFrame:
    """key, born, gone, known. Without a key a record is ignored. Several records of one key live from the first birth to the last
    removal, and for ever if one of them was not removed."""
    rows = records.select(F.col(key).alias("key"), F.col(created).alias("born"), F.col(removed).alias("gone")).where(F.col("key").isNotNull())
    ever = F.count(F.when(F.col("gone").isNull(), 1)) > 0
    always = F.count(F.when(F.col("born").isNull(), 1)) > 0
    return rows.groupBy("key").agg(F.when(~always, F.min("born")).alias("born"), F.when(~ever, F.max("gone")).alias("gone")).withColumn("known", F.lit(True))


def _dead(at: Column) -> Column:
    """Whether a reference at this time misses its record, given known, born and gone; an unknown time or bound never counts against it."""
    return F.col("known").isNull() | F.coalesce(at < F.col("born"), F.lit(False)) | F.coalesce(at >= F.col("gone"), F.lit(False))


def _judged(refs: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, heavy). groups: source, key, month, n, born, gone, known, verdict of every key and month of references: "dead" or "live" if
    its first and last time settle it, else "cut". heavy: key, born, gone, known of the keys with most references, at most MAX_HOT rows."""
    groups = refs.groupBy("source", "key", _month()).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("at").alias("timed"))
    groups = materialize(groups, "references")
    sizes = groups.groupBy("key").agg(F.sum("n").alias("n"))
    total = F.broadcast(sizes.agg(F.sum("n").alias("total")))
    hot = sizes.crossJoin(total).where(F.col("n") * F.lit(MAX_HOT) >= F.col("total")).select("key")
    heavy = materialize(hot.join(alive.join(F.broadcast(hot), "key", "left_semi"), "key", "left"), "heavy")
    checked = groups.join(F.broadcast(heavy), "key")
    rest = groups.join(F.broadcast(heavy.select("key")), "key", "left_anti").hint("merge").join(alive, "key", "left")
    all_dead = F.col("known").isNull() | ((F.col("timed") == F.col("n")) & (F.coalesce(F.col("last") < F.col("born"), F.lit(False)) | F.coalesce(F.col("first") >= F.col("gone"), F.lit(False))))
    all_live = F.coalesce(F.col("first") >= F.col("born"), F.lit(True)) & F.coalesce(F.col("last") < F.col("gone"), F.lit(True))
    verdict = F.when(all_dead, "dead").when(all_live, "live").otherwise("cut").alias("verdict")
    cols = ["source", "key", "month", "n", "born", "gone", "known", verdict]
    return materialize(checked.select(*cols).unionByName(rest.select(*cols)), "judged"), heavy


def _month() -> Column:
    """The UTC month of a reference; '' for an unknown time, so that it joins."""
    return F.coalesce(utc_month(F.col("at")), F.lit("")).alias("month")


def _dead_rows(refs: DataFrame, groups: DataFrame, heavy: DataFrame) -> DataFrame:
    """source, record_id, key, month of the orphans: rows of heavy keys by a broadcast of these keys' lives, other rows by a shuffle join
    with the groups that are dead or cut. No key of those holds more than 1/MAX_HOT of the rows."""
    cols = ["source", "record_id", "key", "month"]
    rows = refs.withColumn("month", _month())
    checked = rows.join(F.broadcast(heavy), "key").where(_dead(F.col("at"))).select(*cols)
    bad = groups.where("verdict != 'live'").join(F.broadcast(heavy.select("key")), "key", "left_anti").select("source", "key", "month", "born", "gone", "known")
    rest = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").hint("merge").join(bad, ["source", "key", "month"])
    return checked.unionByName(rest.where(_dead(F.col("at"))).select(*cols))


def orphans(refs: DataFrame, alive: DataFrame) -> DataFrame:
    """source_table, record_id of every orphan row, repeats included."""
    groups, heavy = _judged(refs, alive)
    return _dead_rows(refs, groups, heavy).select(F.col("source").alias("source_table"), "record_id")


def orphan_counts(refs: DataFrame, alive: DataFrame) -> DataFrame:
    """Per source and UTC month of the reference: n_references, n_orphans, n_orphan_keys (distinct keys of orphans).

    Only groups that a birth or removal cuts through go back to their rows. A null time gives the month null.
    """
    groups, heavy = _judged(refs, alive)
    cut = groups.where("verdict = 'cut'").select("source", "key", "month")
    dead = _dead_rows(refs, groups.where("verdict = 'cut'"), heavy).groupBy("source", "key", "month").agg(F.count(F.lit(1)).alias("dead")).join(cut, ["source", "key", "month"])
    both = groups.join(dead, ["source", "key", "month"], "left")
    gone = F.when(F.col("verdict") == "dead", F.col("n")).otherwise(F.coalesce("dead", F.lit(0)))
    counted = both.select(F.col("source").alias("source_table"), F.nullif("month", F.lit("")).alias("month"), "n", gone.alias("dead"))
    return counted.groupBy("source_table", "month").agg(F.sum("n").alias("n_references"), F.sum("dead").cast("bigint").alias("n_orphans"), F.count(F.when(F.col("dead") > 0, 1)).alias("n_orphan_keys"))
