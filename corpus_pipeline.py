"""The corpus pipeline: quality rules, one of each group of near copies, secrets redacted, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftmark.llm.common import shared_dir, table
from siftmark.llm.jaccard import one_of_each
from siftmark.llm.packing import pack_documents
from siftmark.llm.quality import cascade
from siftmark.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have too few words and go; repeated rows are judged alike; whole texts count."""
    return cascade(docs).where("rejected_by IS NULL").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, which is null only if all are. Rows without words all stay; of repeated rows one stays."""
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted. Null texts stay null, and n_chars follows the text."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens. Null text is empty: just the end id. A very long text is cut over sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard), ("secret scans", secret_scans), ("packing", packing)]
#: SQL cannot express the tokenizer; the rows are tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder, as the next ones read them more than once.

    An empty table gives no rows. Other columns of documents stay up to the last stage, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
