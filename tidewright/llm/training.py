"""Bounded training samples, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import held_out


def bounded_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """About *n* of *rows* (all of them, if fewer), chosen by a hash of *key*: the same ones on every run."""
    total = rows.count()
    return rows if total <= n else rows.filter(F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(total)) < n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """(doc_id, text, label int) of about *n* labelled documents that may be learnt from, those held out not among them.

    Rows without label or doc_id don't count; repeated label rows count once, with the largest label.
    """
    slim = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    slim = slim.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = bounded_sample(slim, n)
    # n bounds the chosen ids, so they can go to every executor
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
