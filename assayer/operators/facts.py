"""Merging of facts that adapters deliver in parts, and matching of facts between adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_records(*parts: DataFrame) -> DataFrame:
    """All records once; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct()


def merge_backends(*parts: DataFrame) -> DataFrame:
    """One row for each backend id, with the least version."""
    return union_records(*parts).groupBy("id").agg(F.min("version").alias("version"), F.bool_or("native").alias("native"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("capabilities")))).alias("capabilities"))


def merge_identifiers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("package", "identifier").agg(F.sum("production_references").alias("production_references"), F.sum("test_references").alias("test_references"))


def merge_features(rows: DataFrame) -> DataFrame:
    """References add up, what is enabled is united, gated only if every record is."""
    return rows.groupBy("package", "name").agg(F.sum("references").alias("references"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("enables")))).alias("enables"), F.bool_and("target_gated").alias("target_gated"))


def merge_reliability(rows: DataFrame) -> DataFrame:
    """One row: a family is reliable if some adapter says so."""
    return rows.agg(*(F.bool_or(c).alias(c) for c in rows.columns))


def merge_functions(rows: DataFrame) -> DataFrame:
    """Copies of a function from several translation units: the greatest complexity stays."""
    return rows.groupBy("file", "stable_symbol", "start_line", "end_line").agg(F.max("complexity").alias("complexity"), F.min("name").alias("name"))


def _leaf(c) -> Column:
    return F.regexp_extract(c, r"([^:.\s]+)$", 1)


def structural_claims(native: DataFrame, structural: DataFrame) -> DataFrame:
    """(structural_id, native_id): facts of one function in two adapters, claimed uniquely both ways.

    Candidates lie in one file, overlap in lines and have one name or last segment; an exact name beats a
    last segment. A fact with several candidates left, or a native function claimed twice, is not merged.
    """
    n = native.select("file", F.col("function_id").alias("native_id"), F.col("name").alias("n_name"), F.col("start_line").alias("n_start"), F.col("end_line").alias("n_end"), _leaf("name").alias("leaf"))
    s = structural.select("file", F.col("function_id").alias("structural_id"), F.col("name").alias("s_name"), "start_line", "end_line", _leaf("name").alias("leaf"))
    met = s.join(n, ["file", "leaf"]).where((F.col("n_start") <= F.col("end_line")) & (F.col("start_line") <= F.col("n_end"))).withColumn("exact", (F.col("n_name") == F.col("s_name")).cast("int"))
    best = met.groupBy("structural_id").agg(F.max("exact").alias("exact"))
    kept = met.join(best, ["structural_id", "exact"])
    one = kept.groupBy("structural_id").agg(F.count("*").alias("n"), F.min("native_id").alias("native_id")).where("n = 1")
    alone = one.groupBy("native_id").agg(F.count("*").alias("claims")).where("claims = 1")
    return one.join(alone, "native_id", "left_semi").select("structural_id", "native_id")


def symbol_parts(c) -> Column:
    head = F.substring_index(F.substring_index(c, "[cfg:", 1), "<", 1)
    return F.filter(F.split(head, r"[^\p{L}\p{N}_]"), lambda p: p != "")


def _windows(parts: Column) -> Column:
    """All runs of neighbouring parts, once each."""
    at = F.sequence(F.lit(1), F.size(parts))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.slice(parts, i, n)))))


def _heads(parts: Column) -> Column:
    """The first part, the first two, and so on; none of no parts."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n)), lambda x: F.size(x) > 0)


def _without_prefix(parts: Column, prefix: Column) -> Column:
    return F.when((F.size(prefix) > 0) & (F.slice(parts, F.lit(1), F.size(prefix)) == prefix), F.slice(parts, F.size(prefix) + 1, F.size(parts))).otherwise(parts)


def best_symbols(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(test, reference, symbol): the only best-scoring symbol of the package for a test's reference.

    ``references``: package, test, reference. ``symbols``: package, symbol. Three points where the
    symbol's path occurs in the reference, one where its last segment does, two more where the test lies
    within the symbol's owner. No test meets the symbols of an owner or of a last segment one by one: symbols
    are counted by path, by owner and by last segment, with the least of them. Paths are looked up by equality,
    from the reference's runs of parts and from the heads of the test's own path with a part of the reference
    (three points or more). Where there is none, all symbols of the owners around the test have two points, and
    without these all with a last segment in the reference have one.
    """
    pkg = symbol_parts(F.coalesce("package", F.lit("")))
    r = references.withColumn("ref", F.filter(symbol_parts("reference"), lambda p: ~p.isin("crate", "self", "super"))).withColumn("context", _without_prefix(symbol_parts("test"), pkg)).where((F.size("ref") > 0) & F.col("test").isNotNull())
    r = r.select("package", "test", "reference", "ref", "context").distinct()
    s = symbols.select("package", "symbol").distinct().withColumn("path", _without_prefix(symbol_parts("symbol"), pkg)).where(F.size("path") > 0)
    s = s.withColumn("owner", F.slice("path", F.lit(1), F.size("path") - 1))
    told = [F.count("*").alias("n"), F.min("symbol").alias("symbol")]
    key = ["package", "test", "reference"]
    paths = s.groupBy("package", "path", "owner").agg(*told)
    owners = s.where(F.size("owner") > 0).groupBy("package", F.col("owner").alias("key")).agg(*told)
    leaves = s.groupBy("package", F.element_at("path", -1).alias("key")).agg(*told)
    runs, inner = _windows(F.col("ref")), F.flatten(F.transform(_heads(F.col("context")), lambda h: F.transform(F.array_distinct("ref"), lambda p: F.concat(h, F.array(p)))))
    inside = F.exists(_heads(F.col("context")), lambda h: h == F.col("owner"))
    by_path = r.select(*key, "context", "ref", F.explode(F.array_union(runs, inner)).alias("path")).join(paths, ["package", "path"])
    by_path = by_path.select(*key, (F.when(F.array_contains(_windows(F.col("ref")), F.col("path")), 3).otherwise(1) + F.when(inside, 2).otherwise(0)).alias("score"), "n", "symbol").where("score > 2")
    by_owner = r.select(*key, F.explode(_heads(F.col("context"))).alias("key")).join(owners, ["package", "key"]).select(*key, F.lit(2).alias("score"), "n", "symbol")
    by_leaf = r.select(*key, F.explode(F.array_distinct("ref")).alias("key")).join(leaves, ["package", "key"]).select(*key, F.lit(1).alias("score"), "n", "symbol")
    totals = by_path.unionByName(by_owner).unionByName(by_leaf).groupBy(*key, "score").agg(F.sum("n").alias("n"), F.min("symbol").alias("symbol"))
    best = totals.groupBy(*key).agg(F.max_by(F.struct("n", "symbol"), "score").alias("x"))
    return best.where("x.n = 1").select(*key, "x.symbol")


def report_summary(rules: DataFrame, omitted: DataFrame, over_limit: int, groups: int, survived: int, no_coverage: int, counted: tuple[str, ...] = ("crap.maximum", "dry.clone", "mutation.surviving-mutant")) -> DataFrame:
    """One row: rule results, failures, omissions, and findings without rule rows counted already."""
    first = over_limit + groups + survived + no_coverage
    left = omitted.agg(F.count("*").alias("omitted_checks"))
    told = rules.agg(F.count("*").alias("rule_results"), F.count_if(F.col("result") == "fail").alias("rule_failures"), (F.count_if((F.col("result") == "fail") & ~F.col("rule_id").isin(*counted)) + first).alias("findings"))
    return told.withColumn("omitted_checks", left.scalar())
