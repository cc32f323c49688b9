"""Shared-folder tables and small column helpers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.sources.scratch import scratch_path

#: Space characters of every contract in this package: blank, tab, line feed, vertical tab, form feed, return.
SPACE = "\\x20\\x09-\\x0D"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """*df* as a parquet table in the shared folder: cuts the lineage and survives lost executors."""
    return write_table(df, name, compression)[0]


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """As written(), with the table's path, for forget()."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores if it comes in fewer partitions than there are: one small file would be one task.

    Large tables come in more partitions and pass unchanged, without a shuffle. Only for plain scans: counting the partitions of
    anything else could run it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table.repartition(cores) if parts < cores else table


def unused_names(n: int, *tables: DataFrame) -> list[str]:
    """*n* column names that none of *tables* has."""
    taken = {c.lower() for t in tables for c in t.columns}
    names = (f"_{j}_" for j in range(n + len(taken)))
    return [name for name in names if name not in taken][:n]


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not spaces (see SPACE); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else: lower() where the text is ASCII, translate() where it isn't."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
