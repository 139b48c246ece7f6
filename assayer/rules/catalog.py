"""The rules, over fact tables. Evidence texts are fixed values: ids depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import cohesion, mutation, packages, unused
from assayer.rules.engine import bounded_inventory, or_sentinel, rule_rows, union

DEFAULTS = {
    "crap": 6.0, "similarity": 0.92, "mutation_score": 0.8, "complexity": 12, "nesting": 5, "statements": 60, "parameters": 6,
    "module_dependencies": 16, "fan_out": 12, "cohesion": 0.1, "unused": 0,
}
ROOT = "Cargo.toml"


def _symbol():
    return F.when(F.col("stable_symbol") == "", F.col("name")).otherwise(F.col("stable_symbol"))


def crap(functions: DataFrame, limit: float = DEFAULTS["crap"]) -> DataFrame:
    return rule_rows(functions.where("crap IS NOT NULL"), "crap.maximum", F.col("file"), _symbol(), "maximum", "crap-formula-v1", F.col("crap"), limit)


def kiss(functions: DataFrame, **limits: float) -> DataFrame:
    """Four rows for each reliable function: complexity, nesting, statements and parameters."""
    lim = DEFAULTS | limits
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(c).cast("double").alias("m"), F.lit(float(lim[k])).alias("a"), F.lit(e).alias("e")) for r, c, k, e in (
        ("kiss.cyclomatic-complexity", "complexity", "complexity", "cyclomatic-complexity-v1"), ("kiss.nesting-depth", "nesting_depth", "nesting", "nesting-depth-v1"),
        ("kiss.function-statements", "statement_count", "statements", "recursive-statements-v1"), ("kiss.parameter-count", "parameter_count", "parameters", "parameter-count-v1"),
    )))
    rows = functions.where("structural_metrics_reliable").select("file", _symbol().alias("s"), F.explode(rules).alias("r"))
    return rule_rows(rows, F.col("r.rule"), F.col("file"), F.col("s"), "maximum", F.col("r.e"), F.col("r.m"), F.col("r.a"))


def dry(groups: DataFrame, limit: float = DEFAULTS["similarity"], min_statements: int = 5) -> DataFrame:
    """``groups``: first_file, identity, clone_group_id, similarity, statement_count."""
    rows = rule_rows(groups.where(F.col("statement_count") >= min_statements), "dry.clone", F.col("first_file"), F.col("identity"), "maximum-exclusive", F.coalesce("clone_group_id", "identity"), F.coalesce("similarity", F.lit(1.0)), limit)
    none = rule_rows(groups.sparkSession.range(1), "dry.clone", ROOT, "repository clone inventory", "maximum-exclusive", "empty-clone-inventory-v1", 0.0, limit)
    return or_sentinel(rows, none)


def mutants(results: DataFrame, evidence: str, limit: float = DEFAULTS["mutation_score"]) -> DataFrame:
    """The score row and a row for each survivor, or the row of an empty survivor inventory."""
    score = mutation.mutation_score(results).where("score IS NOT NULL")
    scored = rule_rows(score, "mutation.score", ROOT, "repository mutation set", "minimum", evidence, F.col("score"), limit)
    alive = rule_rows(results.where("status = 'survived'"), "mutation.surviving-mutant", F.col("file"), F.col("stable_symbol"), "boolean", F.col("fingerprint"), measured_flag=True, allowed_flag=False)
    none = rule_rows(score, "mutation.surviving-mutant", ROOT, "repository mutation survivor inventory", "boolean", "empty-survivor-inventory-v1", measured_flag=False, allowed_flag=False)
    return scored.unionByName(or_sentinel(alive, none))


def dependency_counts(packages_: DataFrame, dependencies: DataFrame, limit: int = DEFAULTS["module_dependencies"]) -> DataFrame:
    c = packages.coupling(packages_, dependencies)
    return rule_rows(c, "kiss.module-dependency-count", packages.manifest_file("root"), F.col("name"), "maximum", "production-dependency-count-v1", F.col("efferent"), limit)


def coupling(packages_: DataFrame, dependencies: DataFrame, fan_out: int = DEFAULTS["fan_out"]) -> DataFrame:
    """Fan-out and the three informational rows of each package."""
    c = packages.coupling(packages_, dependencies).withColumn("m", packages.manifest_file("root"))
    out = rule_rows(c, "solid.maximum-module-fan-out", F.col("m"), F.col("name"), "maximum", "package-production-fan-out-v1", F.col("efferent"), fan_out)
    told = F.array(*(F.struct(F.lit(f"coupling.{n}").alias("rule"), F.col(n).cast("double").alias("v")) for n in ("afferent", "efferent", "instability")))
    rows = c.select("m", "name", F.explode(told).alias("r"))
    return out.unionByName(rule_rows(rows, F.col("r.rule"), F.col("m"), F.col("name"), "informational", F.col("r.rule"), F.col("r.v")))


def _edge_rows(edges: DataFrame, packages_: DataFrame, rule: str) -> DataFrame:
    rows = packages.manifests(packages_, edges, "package")
    return rule_rows(rows, rule, F.col("file"), F.concat("package", F.lit(" -> "), "dependency"), "boolean", F.concat("package", F.lit("->"), "dependency"), measured_flag=F.col("passed"), allowed_flag=True)


def architecture(packages_: DataFrame, dependencies: DataFrame, layers: DataFrame | None = None, forbidden: list[str] = (), domain=((), ()), interface=((), ())) -> DataFrame:
    """Direction, forbidden edges, domain and interface separation, cycles."""
    edges = packages.production_edges(dependencies).where("internal").select("package", "dependency").distinct()
    one = packages_.sparkSession.range(1)
    parts = []
    for rule, told in (("solid.forbidden-module-edge", packages.forbidden_edges(edges, list(forbidden))), ("solid.domain-to-infrastructure", packages.separated(edges, *domain)), ("solid.interface-to-implementation", packages.separated(edges, *interface))):
        none = rule_rows(one, rule, ROOT, "repository internal dependency inventory", "boolean", "empty-internal-edge-inventory-v1", measured_flag=True, allowed_flag=True)
        parts.append(or_sentinel(_edge_rows(told, packages_, rule), none))
    if layers is not None:
        none = rule_rows(one, "solid.dependency-direction", ROOT, "repository layered dependency inventory", "boolean", "empty-layer-edge-inventory-v1", measured_flag=True, allowed_flag=True)
        parts.append(or_sentinel(_edge_rows(packages.edge_directions(edges, layers), packages_, "solid.dependency-direction"), none))
    internal = packages.internal_edges(packages_, dependencies)
    rings = packages.cycles(internal.select(F.col("package").alias("a"), F.col("dependency").alias("b")))
    ring_rows = rule_rows(rings, "solid.package-cycle", ROOT, F.array_join("cycle", " -> "), "boolean", F.array_join("cycle", "|"), measured_flag=True, allowed_flag=False)
    none = rule_rows(one, "solid.package-cycle", ROOT, "repository package dependency graph", "boolean", "acyclic-package-graph-v1", measured_flag=False, allowed_flag=False)
    return union(*parts, or_sentinel(ring_rows, none))


def contracts(implementations: DataFrame, tests: DataFrame, traits: list[str], marker: str) -> DataFrame:
    told = unused.covered_contracts(implementations, tests, traits, marker)
    rows = rule_rows(told, "solid.subtype-contract-test", F.col("file"), F.concat("implementation_symbol", F.lit(" for "), "trait_symbol"), "boolean", F.concat_ws("|", "trait_symbol", "implementation_symbol", F.lit(marker)), measured_flag=F.col("covered"), allowed_flag=True)
    none = rule_rows(told.sparkSession.range(1), "solid.subtype-contract-test", ROOT, "configured contract implementation inventory", "boolean", "empty-contract-implementation-inventory-v1", measured_flag=True, allowed_flag=True)
    return or_sentinel(rows, none)


def cohesion_rows(functions: DataFrame, limit: float = DEFAULTS["cohesion"]) -> DataFrame:
    c = cohesion.module_cohesion(functions)
    return rule_rows(c, "cohesion.module", F.col("file"), F.col("owner"), "minimum", "qualified-owner-function-reference-graph-v1", F.col("cohesion"), limit)


def yagni(findings: dict[str, DataFrame], allowed: dict[str, int] | None = None) -> DataFrame:
    """``findings`` by rule: unused-private-function, unreferenced-crate-export,
    unused-production-dependency, unused-module, unreachable-code, unused-feature-flag."""
    allowed = allowed or {}
    return union(*(bounded_inventory(f, f"yagni.{r}", allowed.get(r, DEFAULTS["unused"])) for r, f in findings.items()))
