"""Streaming ingest of events: validation, bounded deduplication, user bounds and running popularity.

The reference has no streaming engine; these carry its event contract (known type, known product, each event once, bounds that only widen)
over to unbounded input. Each function takes and returns streaming DataFrames; ``drain`` runs one to its end for batch use and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.clean import EVENT_TYPES
from vitrine.sources.files import scratch

KEY = ["user_id", "product_id", "event_type", "occurred_at"]
#: Events arrive weeks late, so the watermark waits that long and the state of duplicates is bounded by it.
LATENESS = "60 days"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder of Parquet files as a stream."""
    path = f"{folder}/interactions.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{path}*")


def validate(stream: DataFrame, products: DataFrame) -> DataFrame:
    """Events of a known family for a known product (stream-static semi join)."""
    known = F.substring_index("event_type", ".", 1).isin(EVENT_TYPES)
    return stream.where(known).join(products.select("product_id"), "product_id", "left_semi")


def once(stream: DataFrame) -> DataFrame:
    """Each (user, product, type, time) once within the watermark."""
    return stream.withWatermark("occurred_at", LATENESS).dropDuplicatesWithinWatermark(KEY)


def bounds(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").agg(F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"))


def popularity(stream: DataFrame) -> DataFrame:
    return stream.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


def hourly(stream: DataFrame) -> DataFrame:
    """Events per type and hour, closed by the watermark (an extension: the reference has no windows)."""
    return stream.withWatermark("occurred_at", LATENESS).groupBy(F.window("occurred_at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there and returns the result. Append mode writes Parquet; complete mode writes each batch over the last
    one, so the result is read from the shared folder in either case."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
