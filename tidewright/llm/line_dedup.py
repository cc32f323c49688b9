"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded as 128-bit keys with their positions; the text itself is not.
A key's documents are counted on rows that are first made distinct per document,
so a line that a third of all documents share is combined before it is shuffled.
The documents then meet the sorted positions that they lose and put the rest
together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import ascii_lower, unused_names, written

_STRIP = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> Column:
    """What joins a document with its dropped positions: rows that agree in it have the same lines and fate."""
    return F.struct(doc_id.alias("d"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """*docs* (doc_id, text, ...) with the columns kept_text, n_lines and n_dropped added.

    A line's key is the line stripped of blanks, tabs, returns, form feeds and vertical tabs at
    both ends, with A-Z lower-cased. Keys of at least *min_chars* code points that at least
    *min_docs* documents hold lose all their lines, except in the largest doc_id that holds them,
    which keeps every one. Other lines stay in place, whatever their number.

    Null or empty texts are one empty line; texts of any length are taken whole. Rows with the same doc_id are one document when holders
    are counted. Rows without doc_id count together as one document that ranks below every other.
    An empty table gives an empty table. Other columns, nulls in them and any names too, pass through, except that
    kept_text, n_lines and n_dropped replace columns of those names.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    slim = docs.select("doc_id", "text")
    line = F.struct(F.col("pos").cast("int").alias("pos"), F.col("key")).alias("line")
    keys = (
        slim.filter(F.char_length("text") >= min_chars)
        .select("doc_id", "text", F.posexplode(_lines(ascii_lower(F.col("text")))).alias("pos", "raw"))
        .withColumn("key", F.btrim("raw", F.lit(_STRIP)))
        .filter(F.char_length("key") >= min_chars)
        .select(
            _row_key(F.col("doc_id"), F.col("text")).alias("row"),
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(7), F.col("key")).alias("h2"),
            line.getField("pos").alias("pos"),
        )
    )
    holders = keys.select("h1", "h2", F.col("row.d").alias("d")).distinct()
    common = (
        holders.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # as a table of its own it is shuffled for the join alone, so that adaptive execution can split the rows of a hot line
    common = written(common, "common-lines")
    d, a, b, ka, kb, lost_at, split = unused_names(7, docs)
    lost = (
        keys.join(common, ["h1", "h2"])
        .filter(~F.col("row.d").eqNullSafe(F.col("keeper")))
        .groupBy("row")
        .agg(F.collect_set("pos").alias(lost_at))
        .select(F.col("row.d").alias(d), F.col("row.a").alias(a), F.col("row.b").alias(b), lost_at)
    )
    keyed = docs.withColumns({ka: F.xxhash64("text"), kb: F.xxhash64(F.lit(7), F.col("text"))})
    met = keyed.join(lost, (F.col(ka) == F.col(a)) & (F.col(kb) == F.col(b)) & F.col("doc_id").eqNullSafe(F.col(d)), "left")
    n_lines = F.size(_lines(F.col("text"))).cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost_at))
    kept = F.when(F.col(lost_at).isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(F.col(split), i + 1)), "\n")
    )
    return (
        met.withColumn("n_lines", n_lines)
        .withColumn("n_dropped", F.coalesce(F.size(lost_at), F.lit(0)).cast("long"))
        .withColumn(split, F.when(F.col(lost_at).isNotNull(), _lines(F.col("text"))))
        .withColumn("kept_text", kept)
        .drop(d, a, b, ka, kb, lost_at, split)
    )
