"""Cutting lineage through a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset (single-machine tests) a temporary folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "vitrine-shared")
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, so that several consumers share one computation and a lost executor
    costs no recomputation of what came before. The files are removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vitrine-{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(df: DataFrame, column: str, label: str) -> str:
    """Writes ``df`` once to the shared folder, each value of ``column`` to a folder ``column=value`` of its own, and returns the URI, for
    tasks that read the parts they need themselves. The files are removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vitrine-{label}-{uuid.uuid4().hex}"
    df.write.mode("error").partitionBy(column).parquet(path)
    forget_later(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return f"{whole.getScheme()}://{whole.getAuthority() or ''}{whole.getPath()}"


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more, as an iteration leaves one behind in every round."""
    for path in df.inputFiles():
        folder = path.rsplit("/", 1)[0]
        if "/vitrine-" in folder:
            _delete(df.sparkSession, folder)
            return


def forget_later(spark: SparkSession, path: str) -> None:
    """Removes the path when the driver's Python ends."""
    _written.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session may be gone already
            pass


atexit.register(_remove)
