"""Runs kept in buckets, counts observed while rows are written, linked paths."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import clones, coverage
from assayer.rules import engine


def rows(spark, n, shift):
    df = spark.range(n).select(F.concat(F.lit("src/f"), (F.col("id") % 7).cast("string")).alias("file"), F.col("id").cast("string").alias("s"), ((F.col("id") + shift) % 5).alias("m"))
    return engine.rule_rows(df, "r.x", F.col("file"), F.col("s"), "maximum", "e", F.col("m"), 2)


def test_kept_runs_are_compared_without_an_exchange(spark, tmp_path):
    now, before = rows(spark, 300, 1), rows(spark, 280, 0)
    a = engine.save_rules(now, "run_now", "scope-1", 4, str(tmp_path / "now"))
    engine.save_rules(before, "run_before", "scope-1", 4, str(tmp_path / "before"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = engine.kept_rules(spark, "run_before", "scope-1")
        out = engine.with_baseline(a, b)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(str, out.select("violation_id", "baseline").collect())) == sorted(map(str, engine.with_baseline(now, before).select("violation_id", "baseline").collect()))
        gone = b.join(a.select("violation_id"), "violation_id", "left_anti")
        assert "Exchange" not in gone._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ValueError, match="another analysis scope"):
            engine.kept_rules(spark, "run_before", "scope-2")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE run_now")
        spark.sql("DROP TABLE run_before")


def test_counts_are_seen_as_rows_are_written(spark, tmp_path):
    some = rows(spark, 100, 0).withColumn("file", F.when(F.col("stable_symbol") == "7", "../up").otherwise(F.col("file"))).withColumn("result", F.when(F.col("stable_symbol") == "8", "pass").otherwise(F.col("result")))
    got = engine.write_counted(some, str(tmp_path / "rules"), engine.outcome_counts())
    want = engine.summary(some).first()
    assert (got["evaluated"], got["passed"], got["failed"]) == (want.evaluated, want.passed, want.failed) == (100, 61, 39)
    assert (got["wrong_path"], got["wrong_id"], got["wrong_outcome"]) == (1, 0, 1)
    assert spark.read.parquet(str(tmp_path / "rules")).count() == 100
    applied = spark.createDataFrame([("matched",), ("ambiguous",), ("matched",), ("unmatched-file",)], "reason string")
    assert engine.write_counted(applied, str(tmp_path / "applied"), coverage.reason_counts()) == coverage.application_counters(applied).first().asDict() == {"matched_functions": 2, "unmatched_functions": 1, "empty_ranges": 0, "ambiguous_functions": 1}
    assert set(engine.write_counted(applied.limit(0), str(tmp_path / "none"), coverage.reason_counts()).values()) == {0}


def test_linked_paths_are_resolved_after_the_joined_ones(spark):
    files = spark.createDataFrame([("src/a.c",), ("lib/deep/b.c",), ("own/c.c",), ("loop/d.c",), ("both/e.c",)], "file string")
    reported = spark.createDataFrame([("/real/a.c",), ("/else/x/b.c",), ("/r/own/c.c",), ("/r/both/e.c",), ("/real2/e.c",), ("/q/a.c",), ("/q/b.c",)], "file string")
    links = spark.createDataFrame([("/r/src", "/real"), ("/r/lib", "/mid"), ("/mid/deep", "/else/x"), ("/r/loop", "/r/loop/on"), ("/r/both", "/real2")], "path string, target string")
    got = {r.file: r.reported for r in coverage.resolve_files(files, reported, "/r", links).collect()}
    assert got == {"src/a.c": "/real/a.c", "lib/deep/b.c": "/else/x/b.c", "own/c.c": "/r/own/c.c", "both/e.c": "/r/both/e.c"}
    assert {r.file for r in coverage.resolve_files(files, reported, "/r").collect()} == {"own/c.c", "both/e.c"}


def test_groups_have_the_least_sizes_of_their_members(spark):
    g = spark.createDataFrame([("a", ["a", "b"]), ("c", ["c", "d"])], "label string, members array<string>")
    f = spark.createDataFrame([("a", ["x"] * 9, 4), ("b", ["x"] * 8, 5), ("c", ["x"] * 7, 1), ("d", ["y"] * 7, 3)], "file string, tokens array<string>, statement_count int")
    assert {(r.label, r.token_count, r.statement_count) for r in clones.group_measures(g, f).collect()} == {("a", 8, 4), ("c", 7, 1)}
