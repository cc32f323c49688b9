"""Running a stream over what a source holds now, to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.scratch import scratch_path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* as a stream of files. It is named by a pattern: a stream's plain path would have to be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_in_parts(df: DataFrame, key: str, order: str, parts: int = 3) -> DataFrame:
    """*df* as a stream of several micro-batches: written in *parts* one after the other by *order*, a key's rows of a part in one file."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "parts")
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    most, done = 1, 0
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.filter(F.col(order) > low)
        (part if high is None else part.filter(F.col(order) <= high)).repartition(key).write.mode("append").parquet(path)
        files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
        most, done = max(most, files - done), files
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", most).parquet(path)


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run *df* over all that is there and return what it wrote. In complete mode the last batch's result replaces what came before."""
    spark = df.sparkSession
    out, marks = scratch_path(spark, "stream"), scratch_path(spark, "stream-marks")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
