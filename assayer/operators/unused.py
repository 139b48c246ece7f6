"""Inventories of what nothing uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import reference_leaf, simple_name
from assayer.operators.packages import manifests, production_edges


def declarations(functions: DataFrame) -> DataFrame:
    """(package, leaf, declarations) of reliable functions."""
    return functions.where("structural_metrics_reliable").groupBy("package", simple_name("stable_symbol").alias("leaf")).agg(F.count("*").alias("declarations"))


def unused_functions(functions: DataFrame, identifiers: DataFrame, visibility: str, entry_points: list[str] = ()) -> DataFrame:
    """Findings (file, symbol, evidence): functions of the visibility, declared once in their package,
    whose name is not used beyond the declaration and in no other function's references."""
    f = functions.withColumn("stable_symbol", F.when(F.col("stable_symbol") == "", F.col("name")).otherwise(F.col("stable_symbol"))).withColumn("leaf", simple_name("stable_symbol"))
    live = F.col("structural_metrics_reliable") & F.col("production")
    entry = F.lit(False)
    for e in entry_points:
        entry = entry | (F.col("stable_symbol") == e) | F.endswith("file", F.lit(e))
    cand = f.where(live & (F.col("visibility") == visibility) & ~F.col("entry_point") & ~entry)
    once = declarations(f).where("declarations = 1 AND package IS NOT NULL")
    cand = cand.join(once, ["package", "leaf"]).join(identifiers.select("package", F.col("identifier").alias("leaf"), "production_references"), ["package", "leaf"])
    cand = cand.where(F.col("production_references") <= F.col("declarations"))
    # a reference in any other production function of the package; one user of another symbol is enough
    uses = f.where(live).select("package", "stable_symbol", F.explode("references").alias("ref")).select("package", "stable_symbol", reference_leaf("ref").alias("leaf"))
    users = uses.groupBy("package", "leaf").agg(F.min("stable_symbol").alias("first_user"), F.max("stable_symbol").alias("last_user"))
    out = cand.join(users, ["package", "leaf"], "left").where(F.col("first_user").isNull() | ((F.col("first_user") == F.col("stable_symbol")) & (F.col("last_user") == F.col("stable_symbol"))))
    return out.select("file", F.col("stable_symbol").alias("symbol"), F.concat(F.lit("unreferenced-function:"), F.col("leaf")).alias("evidence")).distinct()


def unused_dependencies(packages: DataFrame, dependencies: DataFrame, identifiers: DataFrame, features: DataFrame) -> DataFrame:
    """Production dependencies without an identifier use or a feature that enables them."""
    edges = production_edges(dependencies).withColumn("source", F.when(F.coalesce("source_identifier", F.lit("")) == "", F.col("dependency")).otherwise(F.col("source_identifier")))
    edges = edges.withColumn("identifier", F.replace("source", F.lit("-"), F.lit("_")))
    used = identifiers.where("production_references > 0").select("package", "identifier").distinct()
    enabled = features.select("package", F.explode("enables").alias("e")).select("package", F.regexp_replace(F.regexp_replace("e", r"\??/.*$", ""), "^dep:", "").alias("source")).distinct()
    free = edges.join(used, ["package", "identifier"], "left_anti").join(enabled, ["package", "source"], "left_anti")
    found = manifests(packages, free.select("package", "dependency").distinct(), "package")
    return found.select("file", F.concat("package", F.lit("::dependency::"), "dependency").alias("symbol"), F.concat("package", F.lit("->"), "dependency").alias("evidence")).distinct()


def unused_modules(modules: DataFrame, entry_points: list[str] = ()) -> DataFrame:
    entry = F.lit(False)
    for e in entry_points:
        entry = entry | (F.col("stable_symbol") == e) | F.endswith("file", F.lit(e))
    managed = F.col("target_gated") | F.col("generated") | F.col("framework_managed") | F.col("reflection_reachable") | F.col("externally_invoked")
    out = modules.where((F.col("references") == 0) & (F.col("visibility") != "public") & ~managed & ~entry)
    return out.select("file", F.col("stable_symbol").alias("symbol"), F.lit("unreferenced-production-module-v1").alias("evidence")).distinct()


def unreachable_items(unreachable: DataFrame) -> DataFrame:
    return unreachable.where(~F.col("target_gated")).select("file", F.col("stable_symbol").alias("symbol"), F.col("structural_evidence").alias("evidence")).distinct()


def unused_features(packages: DataFrame, features: DataFrame) -> DataFrame:
    """Features but ``default`` without reference, that enable nothing and that no other one enables."""
    enabled = features.select("package", F.col("name").alias("by"), F.explode("enables").alias("name")).where("by <> name").select("package", "name").distinct()
    free = features.where((F.col("name") != "default") & (F.col("references") == 0) & ~F.col("target_gated") & (F.size("enables") == 0)).join(enabled, ["package", "name"], "left_anti")
    found = manifests(packages, free.select("package", "name").distinct(), "package")
    return found.select("file", F.concat("package", F.lit("::feature::"), "name").alias("symbol"), F.concat(F.lit("unused-feature:"), "name").alias("evidence")).distinct()


def covered_contracts(implementations: DataFrame, tests: DataFrame, traits: list[str], marker: str) -> DataFrame:
    """Implementations of the configured traits with covered: a marked test refers to both symbols."""
    impl = implementations.where(~F.col("target_gated") & F.col("trait_symbol").isin(*traits))
    live = tests.where(~F.col("target_gated") & F.array_contains("markers", marker)).select("referenced_symbols", F.explode(F.array_distinct("referenced_symbols")).alias("implementation_symbol"))
    hit = impl.join(live, "implementation_symbol").where(F.expr("array_contains(referenced_symbols, trait_symbol)")).select("trait_symbol", "implementation_symbol").distinct().withColumn("covered", F.lit(True))
    return impl.join(hit, ["trait_symbol", "implementation_symbol"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def populate_module_references(modules: DataFrame, identifiers: DataFrame, declared: DataFrame) -> DataFrame:
    """references: uses of the module's name in its package beyond its declarations."""
    leaf = F.substring_index("stable_symbol", "::", -1)
    m = modules.drop("references").withColumn("leaf", leaf)
    out = m.join(identifiers.select("package", F.col("identifier").alias("leaf"), "production_references"), ["package", "leaf"], "left").join(declared.select("package", F.col("name").alias("leaf"), "declared"), ["package", "leaf"], "left")
    return out.withColumn("references", F.greatest(F.coalesce("production_references", F.lit(0)) - F.coalesce("declared", F.lit(0)), F.lit(0))).drop("leaf", "production_references", "declared")
