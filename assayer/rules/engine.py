"""Rule rows: measured against allowed, with stable ids, omissions, summaries and baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assayer.functions.columns import path_is_relative, stable_id

EPSILON = 2.220446049250313e-16
COMPARISONS = ("maximum", "maximum-exclusive", "minimum", "boolean", "informational")
COLUMNS = ("rule_id", "violation_id", "file", "stable_symbol", "measured", "allowed", "measured_flag", "allowed_flag", "comparison", "structural_evidence", "algorithm", "result", "excess")


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def excess(comparison, measured, allowed, measured_flag, allowed_flag) -> Column:
    gap = measured - allowed
    inclusive = lambda d: F.when(d > 0, d).otherwise(0.0)
    return (
        F.when(comparison == "maximum", inclusive(gap))
        .when(comparison == "minimum", inclusive(-gap))
        .when(comparison == "maximum-exclusive", F.when(measured < allowed, 0.0).otherwise(F.greatest(gap, F.lit(EPSILON))))
        .when(comparison == "boolean", F.when(measured_flag == allowed_flag, 0.0).otherwise(1.0))
        .otherwise(0.0)
    )


def rule_rows(df: DataFrame, rule_id, file, symbol, comparison: str, evidence, measured=None, allowed=None, measured_flag=None, allowed_flag=None, algorithm: str = "") -> DataFrame:
    """One rule row for each row of ``df``; arguments are columns or constants."""
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}")
    num = lambda x: (F.lit(None) if x is None else _lit(x)).cast("double")
    flag = lambda x: (F.lit(None) if x is None else _lit(x)).cast("boolean")
    rows = df.select(
        _lit(rule_id).alias("rule_id"), _lit(file).alias("file"), _lit(symbol).alias("stable_symbol"), num(measured).alias("measured"), num(allowed).alias("allowed"),
        flag(measured_flag).alias("measured_flag"), flag(allowed_flag).alias("allowed_flag"), F.lit(comparison).alias("comparison"), _lit(evidence).alias("structural_evidence"), _lit(algorithm).alias("algorithm"),
    )
    rows = rows.withColumn("violation_id", stable_id("rule_id", "file", "stable_symbol", "structural_evidence"))
    rows = rows.withColumn("excess", excess(F.col("comparison"), F.col("measured"), F.col("allowed"), F.col("measured_flag"), F.col("allowed_flag")))
    return rows.withColumn("result", F.when(F.col("excess") == 0, "pass").otherwise("fail")).select(*COLUMNS)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def or_sentinel(rows: DataFrame, sentinel: DataFrame) -> DataFrame:
    """``rows``, or the sentinel row where there are none: an inventory that was taken and is empty.
    Whether there are any is a scalar of the plan, no job of its own."""
    some = rows.select(F.lit(1).alias("x")).limit(1).agg(F.count("*").alias("n")).scalar()
    return rows.unionByName(sentinel.where(some == 0))


def bounded_inventory(findings: DataFrame, rule_id: str, allowed: int, algorithm: str = "") -> DataFrame:
    """A row for each finding, each measuring the total; one row of zero without findings."""
    found = findings.select("file", "symbol", "evidence").distinct()
    total = found.agg(F.count("*").alias("n")).scalar()
    rows = rule_rows(found, rule_id, F.col("file"), F.col("symbol"), "maximum", F.col("evidence"), total, allowed, algorithm=algorithm)
    none = findings.sparkSession.range(1).where(total == 0)
    return rows.unionByName(rule_rows(none, rule_id, "Cargo.toml", f"repository inventory::{rule_id}", "maximum", "empty-reliable-inventory-v1", 0, allowed, algorithm=algorithm))


def omissions(spark, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "rule_id string, reason string").distinct()


def order_rules(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rule_id", "file", "stable_symbol", "violation_id")


def summary(rows: DataFrame) -> DataFrame:
    have = "baseline" in rows.columns
    base = [F.count_if(F.col("baseline") == b).alias(f"baseline_{b}") for b in ("new", "worsened", "existing", "improved")] if have else []
    return rows.agg(F.count("*").alias("evaluated"), F.count_if(F.col("result") == "pass").alias("passed"), F.count_if(F.col("result") == "fail").alias("failed"), *base)


def outcome_counts() -> dict[str, Column]:
    """The counts of ``summary`` and of rows that break the contract by themselves, as aggregates."""
    again = excess(F.col("comparison"), F.col("measured"), F.col("allowed"), F.col("measured_flag"), F.col("allowed_flag"))
    return {
        "evaluated": F.count(F.lit(1)), "passed": F.count_if(F.col("result") == "pass"), "failed": F.count_if(F.col("result") == "fail"),
        "wrong_path": F.count_if(~path_is_relative("file")), "wrong_id": F.count_if(~F.coalesce(F.col("violation_id").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        "wrong_outcome": F.count_if((F.col("excess") != again) | ((F.col("result") == "pass") != (F.col("excess") == 0))),
    }


def write_counted(rows: DataFrame, path: str, counts: dict[str, Column]) -> dict[str, int]:
    """Write ``rows`` as Parquet and return the counts: they are observed on the rows as they are written,
    so that no second pass is made."""
    seen = Observation()
    rows.observe(seen, *(c.alias(name) for name, c in counts.items())).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rows that break the contract: path, id, repeated id, or an outcome that does not follow."""
    again = excess(F.col("comparison"), F.col("measured"), F.col("allowed"), F.col("measured_flag"), F.col("allowed_flag"))
    ids = rows.groupBy("violation_id").agg(F.count("*").alias("n"))
    bad = ~path_is_relative("file") | ~F.col("violation_id").rlike("^[0-9a-f]{64}$") | (F.col("n") > 1) | (F.col("excess") != again) | ((F.col("result") == "pass") != (F.col("excess") == 0))
    return rows.join(ids, "violation_id").where(bad).drop("n")


BASELINE = ("rule_id", "violation_id", "file", "stable_symbol", "result", "excess")
_SCOPE = "analysis_scope"


def save_rules(rows: DataFrame, table: str, scope: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Keep rule rows as a table bucketed and sorted by violation, with the scope of its analysis. Runs
    that are kept so, in as many buckets, are compared without an exchange of either."""
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "violation_id").sortBy("violation_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    spark = rows.sparkSession
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_SCOPE}' = '{scope}')")
    return spark.table(table)


def kept_rules(spark: SparkSession, table: str, scope: str) -> DataFrame:
    """The rows of an earlier run; one of another scope is an error."""
    known = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == _SCOPE).collect()}
    if known.get(_SCOPE) != scope:
        raise ValueError("the baseline has another analysis scope")
    return spark.table(table).select(*BASELINE)


def with_baseline(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``current`` with baseline: new, worsened, existing, improved or not-applicable."""
    before = previous.select("violation_id", F.col("result").alias("_before"), F.col("excess").alias("_excess"))
    out = current.join(before, "violation_id", "left")
    failing = F.when(F.col("_before").isNull(), "new").when(F.col("_before") == "pass", "worsened").when(F.col("excess") > F.col("_excess"), "worsened").when(F.col("excess") < F.col("_excess"), "improved").otherwise("existing")
    passing = F.when(F.col("_before") == "fail", "improved").otherwise("not-applicable")
    return out.withColumn("baseline", F.when(F.col("result") == "pass", passing).otherwise(failing)).drop("_before", "_excess")


def resolved(current: DataFrame, previous: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Previous failures of rules that were evaluated whole and no longer occur."""
    gone = previous.where("result = 'fail'").join(current.select("rule_id").distinct(), "rule_id", "left_semi")
    return gone.join(incomplete.select("rule_id").distinct(), "rule_id", "left_anti").join(current.select("violation_id"), "violation_id", "left_anti")


def gate(compared: DataFrame, omitted: DataFrame) -> DataFrame:
    """(gate_passed): nothing new, nothing worsened, nothing omitted."""
    counts = compared.agg(F.count_if(F.col("baseline").isin("new", "worsened")).alias("bad"))
    left = omitted.agg(F.count("*").alias("omitted"))
    return counts.unionByName(left.withColumnRenamed("omitted", "bad")).agg((F.sum("bad") == 0).alias("gate_passed"))
