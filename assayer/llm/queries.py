"""The operators' queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontamination, exact_dedup, html_wrappers, pii_surrogates, quality_classifier, quality_rules, sentencepieces, sharding, simhash, spelling, suffix_dedup, token_shards, whitening
from assayer.llm.sql import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_wrappers": html_wrappers.query,
    "op10_pii_surrogates": pii_surrogates.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_whitening": whitening.query,
    "op13_spelling_variants": spelling.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_token_shards": token_shards.query,
    "op4_quality_rules": quality_rules.query,
    "op5_simhash": simhash.query,
    "op6_sharding": sharding.query,
    "op7_decontamination": decontamination.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_sentencepieces": sentencepieces.query,
}
