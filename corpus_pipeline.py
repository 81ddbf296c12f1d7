"""A training corpus from documents: quality, near duplicates, benchmark, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have
the columns of documents. run() writes what a stage returns as Parquet in the shared
folder, and the next one reads it from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import decontaminate, jaccard_join, packing, quality_rules, queries, secret_scan
from sparquill.llm.common import discard, mark, release, settle, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows equal in id, source and text share a verdict."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates."""
    return jaccard_join.one_of_each(docs, size=5, threshold=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a variant of one."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in them are masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048: a row per piece."""
    return packing.pack(docs, queries.ranks(), capacity=queries.SEQUENCE, control=queries.control())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("packing", pack)]

#: Tokenisation and masking are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; what a stage leaves behind goes when its result is written.

    Null ids, null or empty texts, repeated rows and further columns are handled as the
    stages' operators say; an empty table gives an empty result.
    """
    docs, base, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"{base}/{name}")
            release(spark, since)
            if before:
                discard(spark, before)
            before = f"{base}/{name}"
    return docs
