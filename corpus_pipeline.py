"""The corpus pipeline: five stages from raw documents to token ids, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage rejects is gone for those after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.line_dedup import line_dedup
from tidewright.llm.mixing import mixed_documents
from tidewright.llm.piece_bpe import piece_encode
from tidewright.llm.queries import tokenizer_path
from tidewright.llm.shared import spread, written
from tidewright.llm.simhash import keep_one
from tidewright.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic.

    Null and empty texts have no telling feature and stay; very long ones count whole; repeated rows share their fate; columns of any name pass
    through. An empty table stays empty.
    """
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others share; n_chars counts what is left. A document may end up empty, and a null text does.

    Repeated rows are one document when holders are counted, and lose the same lines; of a shared line's holders the largest doc_id keeps it, and where
    that repeats, each of its rows. Very long texts count whole; columns of any other name pass through. An empty table stays empty.
    """
    kept = line_dedup(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a Jaccard similarity of 0.8 or more.

    Fingerprints of 128 bits whose first 64 differ in at most 14 are candidates; of what these connect, whole sets are compared. Texts without words are
    copies of each other, and texts of any length count whole. Of repeated rows one stays; rows without doc_id stay only where their group has no
    other. An empty table stays empty.
    """
    return keep_one(docs, distance=14, width=5, words=2, alike=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its slots; texts without words are never taken.

    A null source is a source of its own. Repeated rows become one row that is taken as often as they are together; ties in a source's order
    go by doc_id. Very long texts span blocks. An empty table stays empty.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to. Null and empty texts have no ids; every row has a row.

    Repeated rows are encoded alike, very long texts whole; columns beside doc_id, source and text are left out. An empty table stays empty.
    """
    out = piece_encode(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: Stages 1, 3 and 5 can't be expressed in SQL; the tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of *sf_dir*'s documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
