"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents. Every decision takes effect: rejected and repeated documents
go, secrets are cut out of texts, and the mix leaves out or repeats documents before they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm import classifier, jaccard, mixing, packing, secrets
from lumenspan.llm.base import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more. Its word vectors come from all given documents, its network from the labelled ones among them.

    Null and empty texts are scored as texts without words; a score of 0.5 stays; repeated rows are scored alike; texts of any
    length count whole; other columns may have any names; an empty table gives no rows.
    """
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more: the one with the smallest doc_id.

    Null and empty texts are nobody's copy and stay; a similarity of 0.8 is a link; of repeated rows one stays; rows without a
    doc_id come last in a group; unlike texts with one doc_id all stay; other columns may have any names; an empty table
    gives no rows.
    """
    return jaccard.one_of_each(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text.

    Null and empty texts stay as they are; spans that overlap or begin together become one mark; repeated rows are changed
    alike; texts of any length are scanned whole; other columns may have any names; an empty table gives no rows.
    """
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none more than three times.

    Null and empty texts have no words and are never taken; a null source is a source; equal finish times go in the order of
    source and queue; repeated rows and rows without a doc_id are queued each; other columns may have any names; an
    empty table gives no rows.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a row for each piece.

    A null or empty text is its end id alone; a null doc_id stays null; equal lengths go in the order of the rows; repeated
    rows are packed each; texts longer than a sequence are cut; other columns are ignored; an empty table gives no rows.
    """
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage{i}")
    return docs


#: The classifier and the tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
