"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept, written as
Parquet in the shared folder in between. The first four return the columns of documents; the last
returns the pieces of the packed documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import mixing, near_dedup, packing, quality_classifier, secret_scan
from strandlog.llm.tables import table
from strandlog.workspace import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects. It learns from the labelled documents of the table.

    Null and empty texts get the constant's score; without labels every score is 0.5 and all stay. Repeated rows are scored alike; very
    long texts are scored whole; an empty table stays empty.
    """
    model = quality_classifier.fitted(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return quality_classifier.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: shingles of five words, similarity 0.8.

    The one with the least id stays; of repeated rows one. Null ids all stay, as do texts without words, one for each id and text. Texts of
    one id that aren't similar stay each for itself. Very long texts are compared whole; an empty table stays empty.
    """
    return near_dedup.keep_one(docs, size=5, percent=80)


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets within texts; n_chars follows.

    Null and empty texts stay as they are, as do rows without a secret. Rows are judged alone; very long texts are scanned whole.
    """
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that tokens meet the target marginals.

    Null sources and languages are a value of their own; texts without words all stay if their cell has no other. Rows of one id
    stay or go together; an empty table stays empty.
    """
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack documents into sequences of 2048 tokens.

    Null and empty texts are one piece of one token; longer ones than a sequence are cut. Repeated rows are packed each for itself; an
    empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", dedup),
    ("secret scans", scrub),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can state neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
