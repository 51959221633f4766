"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, dropped when the driver ends; a local session without that setting uses one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints/quillframe"
    if not _MADE:
        atexit.register(_drop, spark)
    _MADE.append(f"{base.rstrip('/')}/quillframe-{uuid.uuid4().hex}")
    return _MADE[-1]


def _drop(spark: SparkSession) -> None:
    while _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once and read from there, so that all who ask see the same."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
