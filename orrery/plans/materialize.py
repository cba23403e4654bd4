"""Lineage cuts as Parquet tables in the folder that the cluster shares.

A written table survives the loss of any executor, carries row counts and sizes for adaptive
execution, and can be dropped as soon as its successor is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/orrery"

#: Paths of this process's tables that are not released yet.
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; LOCAL_DIR where it is unset and the session is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def fresh_path(spark: SparkSession, kind: str = "orrery") -> str:
    """A new path in the shared folder, which `sweep` deletes with the tables."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and return a scan of it."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_orrery_path", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete every table that this process has written and not released; results must have been stored by then."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)
