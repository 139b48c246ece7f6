"""Mutants: identity, selection, outcome and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.columns import STATUSES, is_scoreable, mutation_operator, repository_path, seeded_key, stable_id
from assayer.operators.coverage import smallest_container
from assayer.operators.graph import numbered


def fill_symbols(mutants: DataFrame, functions: DataFrame) -> DataFrame:
    """stable_symbol of the smallest function around the line, else ``file::<module>``; operator by family."""
    m = mutants.withColumn("file", F.coalesce(repository_path("file"), F.col("file")))
    points = m.select(F.col("id").alias("point_id"), "file", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    named = functions.withColumn("stable_symbol", F.when(F.col("stable_symbol") == "", F.col("name")).otherwise(F.col("stable_symbol")))
    found = smallest_container(points, named).select(F.col("point_id").alias("id"), "symbol")
    out = m.join(found, "id", "left")
    fallback = F.concat(F.col("file"), F.lit("::<module>"))
    out = out.withColumn("stable_symbol", F.when(F.coalesce("stable_symbol", F.lit("")) == "", F.coalesce("symbol", fallback)).otherwise(F.col("stable_symbol"))).drop("symbol")
    return out.withColumn("operator", F.when(F.coalesce("operator", F.lit("")) == "", mutation_operator("original")).otherwise(F.col("operator")))


KEY = ("file", "stable_symbol", "operator", "original", "replacement")


def json_text(c):
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def fingerprints(mutants: DataFrame) -> DataFrame:
    """Fingerprints from structure and the ordinal among equal candidates; given ones are kept."""
    w = Window.partitionBy(*KEY).orderBy("line", "column", "start_byte", "end_byte", "fingerprint")
    ordinal = F.row_number().over(w) - 1
    evidence = F.concat(F.lit("["), F.concat_ws(",", *(json_text(F.col(c)) for c in ("operator", "original", "replacement")), F.col("ordinal").cast("string")), F.lit("]"))
    made = stable_id(F.lit("mutation.fingerprint"), "file", "stable_symbol", evidence)
    return mutants.withColumn("ordinal", ordinal).withColumn("fingerprint", F.when(F.coalesce("fingerprint", F.lit("")) == "", made).otherwise(F.col("fingerprint"))).drop("ordinal")


def number(mutants: DataFrame) -> DataFrame:
    """Run-local ids in the order of structure."""
    order = ["file", "stable_symbol", "fingerprint", "operator", "original", "replacement"]
    return numbered(mutants.drop("id"), "id", *order)


def select_candidates(mutants: DataFrame, operators: list[str], seed: int) -> DataFrame:
    """Candidates of the operators with their seeded key, in seeded order; a missing or repeated
    fingerprint is an error."""
    if not operators:
        raise ValueError("no mutation operators selected")
    out = mutants.where(F.col("operator").isin(*operators))
    n = F.count("*").over(Window.partitionBy("fingerprint"))
    bad = (F.col("fingerprint") == "") | (n > 1)
    out = out.withColumn("bad", bad).withColumn("seeded_key", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("missing or duplicate fingerprint of "), F.col("file")))).otherwise(seeded_key(F.lit(seed), "fingerprint"))).drop("bad")
    return out.orderBy("seeded_key", "file", "stable_symbol", "fingerprint")


def limit_execution(selected: DataFrame, maximum: int) -> DataFrame:
    """Status pending for the first ``maximum`` in seeded order, ignored for the rest."""
    first = selected.orderBy("seeded_key", "fingerprint").limit(maximum).select("fingerprint").withColumn("chosen", F.lit(True))
    return selected.join(first, "fingerprint", "left").withColumn("status", F.when(F.col("chosen"), "pending").otherwise("ignored")).drop("chosen")


def classify_outcome(results: DataFrame) -> DataFrame:
    """status of a run: compile-error if validation failed, timeout, survived at exit 0, killed, else runtime-error."""
    status = F.when(F.col("validated") == False, "compile-error").when(F.col("timed_out"), "timeout").when(F.col("exit_code").isNull(), "runtime-error").when(F.col("exit_code") == 0, "survived").otherwise("killed")  # noqa: E712
    return results.withColumn("status", status)


def status_counts(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES), F.count("*").alias("total"))


def mutation_score(results: DataFrame, *by: str) -> DataFrame:
    """killed / (killed + survived), null where there are none."""
    scoreable = F.count_if(is_scoreable(F.col("status")))
    killed = F.count_if(F.col("status") == "killed")
    return results.groupBy(*by).agg(killed.alias("killed"), scoreable.alias("scoreable"), (killed / F.nullif(scoreable, F.lit(0))).alias("score"))


def mutation_exit(counts: DataFrame, allow_survivors: bool = False, allow_compile_errors: bool = False) -> DataFrame:
    """0 where all is well, 1 for an operational error, 2 for survivors."""
    broken = (F.col("timeout") + F.col("runtime_error") + F.col("invalid")) > 0
    broken = broken if allow_compile_errors else broken | (F.col("compile_error") > 0)
    left = F.lit(False) if allow_survivors else F.col("survived") > 0
    return counts.withColumn("exit_code", F.when(broken, 1).when(left, 2).otherwise(0))


def check_exit(mutation_code, gate_passed):
    return F.when(mutation_code == 1, 1).when(gate_passed, 0).otherwise(2)


def risk_exit(empty, allow_empty, missing, allow_missing, over):
    return F.when((empty & ~allow_empty) | ((missing > 0) & ~allow_missing), 1).when(over > 0, 2).otherwise(0)
