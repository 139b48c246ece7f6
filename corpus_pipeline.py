"""A training-data pipeline over documents: each stage works on what the one before kept.

Rules turn away junk, near copies leave one document of each group, contaminated documents go,
personal data is replaced by surrogates, and the texts are encoded.

Defined results: documents with a null or empty text fail the base rules and go. Rows that share an id
are documents of their own as long as their texts differ; of equal or near texts the row with the least
id stays, one without an id last, and of wholly equal rows one. A null language is a stratum of its own.
An empty benchmark or label table turns nothing away; an empty table of documents gives an empty table.
Further columns, whatever their names, pass through the filtering stages; the last stage keeps doc_id
beside what it makes. Names that an operator needs (doc_id, text, lang, n_chars) are taken from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontamination, pii_surrogates, quality_rules, sentencepieces, simhash
from assayer.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_surrogates.rewrite_documents(docs, pii_surrogates.session_key(spark))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(docs, sentencepieces.model_path(), keep=["doc_id"])


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("encoding", encoding_stage),
]

#: SQL knows neither XXH64 nor SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
