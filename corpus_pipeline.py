"""From raw documents to packed training sequences: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runmetrics.llm import exact_dedup, langid, packing, pii, simhash
from runmetrics.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; texts without letters, or without a clear language, go."""
    return langid.keep_identified(docs, langid.fit(docs.filter(~langid.held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group that is equal but for white space."""
    return exact_dedup.keep_rows(docs, lambda rows, name: exact_dedup.deduplicate(rows, name).filter("kept").select("doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of fingerprints 3 bits apart or less, one without an id if all are."""
    return exact_dedup.keep_rows(docs, lambda rows, name: simhash.near_duplicates(rows, id_column=name).select(F.col("component_id").alias("doc_id")).distinct())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced."""
    return pii.redact(docs, chars_column="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("personal data", personal_data), ("packing", packed)]

# Tokens, fingerprints and the fitted model aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
