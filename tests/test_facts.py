from pyspark.sql import functions as F

from assayer.operators import facts


def test_merges(spark):
    f = spark.createDataFrame([("p", "x", 1, ["b", "a"], True), ("p", "x", 2, ["a"], False)], "package string, name string, references int, enables array<string>, target_gated boolean")
    r = facts.merge_features(f).first()
    assert (r.references, r.enables, r.target_gated) == (3, ["a", "b"], False)
    i = spark.createDataFrame([("p", "n", 1, 0), ("p", "n", 2, 5), (None, "n", 1, 1)], "package string, identifier string, production_references int, test_references int")
    assert {(x.package, x.production_references, x.test_references) for x in facts.merge_identifiers(i).collect()} == {("p", 3, 5), (None, 1, 1)}
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert facts.union_records(a, b).count() == 2
    assert facts.merge_reliability(spark.createDataFrame([(True, False), (False, False)], "a boolean, b boolean")).first() == (True, False)


def test_claims_are_unique_both_ways(spark):
    row = "file string, function_id string, name string, start_line int, end_line int"
    native = spark.createDataFrame([("a.c", "n1", "f", 1, 5), ("a.c", "n2", "N::g", 7, 9), ("a.c", "n3", "h", 11, 20), ("a.c", "n4", "f", 30, 40)], row)
    structural = spark.createDataFrame([("a.c", "s1", "f", 2, 5), ("a.c", "s2", "g", 7, 9), ("a.c", "s3", "h", 11, 14), ("a.c", "s4", "h", 15, 20)], row)
    assert {tuple(r) for r in facts.structural_claims(native, structural).collect()} == {("s1", "n1"), ("s2", "n2")}


def test_best_symbols(spark):
    refs = spark.createDataFrame([("p", "p::tests::t1", "crate::Shape"), ("p", "p::circle::t2", "Shape"), ("p", "p::t3", "Other"), ("p", "p::t4", "a::Shape")], "package string, test string, reference string")
    syms = spark.createDataFrame([("p", "p::Shape"), ("p", "p::circle::Shape"), ("p", "p::a::Shape"), ("q", "q::Other")], "package string, symbol string")
    got = {r.test: r.symbol for r in facts.best_symbols(refs, syms).collect()}
    assert got == {"p::tests::t1": "p::Shape"}  # two symbols score alike for the others


def test_summary(spark):
    rules = spark.createDataFrame([("crap.maximum", "fail"), ("kiss.nesting-depth", "fail"), ("x", "pass")], "rule_id string, result string")
    r = facts.report_summary(rules, spark.createDataFrame([("y", "z")], "rule_id string, reason string"), 1, 0, 2, 0).first()
    assert (r.rule_results, r.rule_failures, r.findings, r.omitted_checks) == (3, 2, 4, 1)
