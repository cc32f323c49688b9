"""Session construction and table access shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewright", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster pass your own instead, or settings in *conf*.

    The small number of shuffle partitions is for local runs of one process: a cluster's session sets its own. Adaptive execution stays on so that partition counts, skewed joins and small
    broadcasts are decided from run-time sizes rather than from constants here.
    """
    cores = cpus or os.environ.get("BENCH_CPUS", "*")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table *name* below *sf_dir*, always through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
