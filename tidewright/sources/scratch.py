"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or a temporary one where that is unset and everything runs in one process.

    On a cluster a temporary folder would be each machine's own, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-"))
    return context.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; removed when the driver ends, or by forget()."""
    path = f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """*df* as a parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(path: str) -> None:
    """Delete what nothing will read any more, before the driver ends."""
    for entry in [x for x in _made if x[1] == path]:
        _delete(*entry)
        _made.remove(entry)


@atexit.register
def _clean() -> None:
    for entry in _made:
        try:
            _delete(*entry)
        except Exception:  # the session may have ended already  # noqa: BLE001
            return
