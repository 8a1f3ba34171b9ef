"""Folder for intermediate files that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, in the application's own folder; a local folder only where that is unset."""
    return f"{_base(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Times that each application's folder was deleted: what is kept of its files in memory is of one such time.
_CLEANED: Counter[str] = Counter()


def _base(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrove-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def clean(spark: SparkSession) -> bool:
    """Delete all that this application has written for its own steps; call it when its results are stored."""
    app = spark.sparkContext.applicationId
    _CLEANED[app] += 1
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_base(spark)}/{app}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def times_cleaned(spark: SparkSession) -> int:
    return _CLEANED[spark.sparkContext.applicationId]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame and read it back, so that later steps start from files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
