"""Queries that bind orders, kept runs, imports, positions and documents to the driver's tables.

As in ``queries``, each says what stands in for which fact, and runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import columns as fn
from assayer.operators import clones, coverage, facts, intervals, mutation, packages, unused
from assayer.operators.graph import numbered, settle, shared_path
from assayer.plans.queries import DICE, SHINGLE, day_functions, event_lines, mutant_lines, order_functions, read, word_arrays, words, yearly_rules
from assayer.plans.rule_queries import part_functions, unused_dependencies
from assayer.rules import catalog, engine
from assayer.sinks import reports
from assayer.sources import mutation_reports

REPORT_GROUPS = 50


def mutant_symbols(spark, d):
    """Mutants are events, functions the blocks of 12 hours that overlap by half."""
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("file"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("line"), F.lit("").alias("stable_symbol"), F.lit("").alias("operator"), F.lit("==").alias("original"))
    starts = e.select("file", F.explode(F.array(F.floor(F.col("line") / 12), F.floor(F.col("line") / 6))).alias("n")).distinct()
    f = starts.select("file", F.concat(F.lit("b"), "n").alias("name"), F.lit("").alias("stable_symbol"), (F.col("n") * 6).cast("int").alias("start_line"), (F.col("n") * 6 + 11 - F.col("n") % 3).cast("int").alias("end_line")).withColumn("function_id", F.concat_ws("/", "file", "name"))
    return mutation.fill_symbols(e, f).select(F.col("id").alias("event_id"), "stable_symbol", "operator")


def mutant_numbers(spark, d):
    m = mutant_lines(spark, d).select(F.lit(0).alias("id"), F.concat(F.lit("src/"), "l_suppkey").alias("file"), F.concat(F.lit("f"), "l_linenumber").alias("stable_symbol"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fingerprint"), F.lit("comparison").alias("operator"), "original", F.lit("!=").alias("replacement"))
    return mutation.number(m).select("id", "fingerprint")


def numbered_rules(spark, d):
    """The order of the rule section, as places."""
    rows = catalog.kiss(order_functions(spark, d), complexity=5, parameters=2)
    return numbered(rows, "place", "rule_id", "file", "stable_symbol", "violation_id").select("violation_id", "place")


def numbered_diagnostics(spark, d):
    """Diagnostics are events; what was only looked at has no place."""
    kind, at = F.col("event_type"), F.col("event_type") != "view"
    e = read(spark, d, "events").select(
        "event_id", F.when(kind == "error", "error").when(kind == "purchase", "warning").otherwise("info").alias("severity"), F.when(at, F.concat(F.lit("u"), "user_id")).alias("file"), F.when(at, F.hour("ts")).alias("start_line"),
        F.when(at, F.minute("ts")).alias("start_column"), F.when(at, F.hour("ts") + 1).alias("end_line"), F.when(at, F.second("ts")).alias("end_column"), kind.alias("backend"), F.col("event_id").cast("string").alias("message"), F.lit(False).alias("fallback_used"),
    )
    return numbered(e, "place", *reports.diagnostic_order()).select("event_id", "place")


def numbered_mutants(spark, d):
    """Results of order lines in the order of the report."""
    m = mutant_lines(spark, d).select(
        F.concat(F.lit("src/"), F.col("l_suppkey") % 9).alias("file"), F.concat(F.lit("f"), "l_linenumber").alias("stable_symbol"), fn.mutation_operator("original").alias("operator"), F.lit("").alias("fingerprint"), F.lit(1).alias("line"),
        F.col("l_linenumber").alias("column"), (F.col("l_orderkey") % 100).alias("id"), "original", F.lit("x").alias("replacement"), "status", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 4).alias("exit_code"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("double").alias("duration"),
    )
    return numbered(m, "place", *reports.mutant_order()).select("place", "file", "operator", "id", "status", "exit_code")


def reported_groups(spark, d):
    """The first groups of the report: orders by their lines, places are parts."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("start_line")))).alias("places"), F.count("*").alias("token_count"))
    return clones.order_groups(li.select(F.col("l_orderkey").alias("group_id"), "token_count", "places"), REPORT_GROUPS).select("group_id", "token_count", F.size("places").alias("places"))


def unresolved_mutants(spark, d):
    m = mutant_lines(spark, d).withColumn("unresolved", fn.is_unresolved("status"))
    return m.groupBy("l_suppkey", "unresolved").agg(F.count("*").alias("n"))


def policy_coverage(spark, d):
    """A report of the users' purchases only: other users' functions count as uncovered."""
    lines = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("file"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("line"), F.lit(1).alias("hits")).distinct()
    out = coverage.apply_coverage(day_functions(spark, d, 24), lines, True, True)
    return out.select("function_id", "reason", F.round("coverage", 6).alias("coverage"), F.round("crap", 6).alias("crap"))


def span_relations(spark, d):
    """Lines of an order as spans: which have text in common, and which lie in which."""
    span = F.struct(F.col("l_linenumber").alias("start_line"), (F.col("l_partkey") % 10).alias("start_column"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end_line"), (F.col("l_suppkey") % 10 + 10).alias("end_column"))
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), span.alias("span"), span["start_line"].alias("start"), span["end_line"].alias("end"))
    met = intervals.intersecting_itself(lines, "start", "end", ["l_orderkey"])
    met = met.where((F.col("a.line") != F.col("b.line")) & fn.spans_intersect("a.span", "b.span"))
    return met.select("l_orderkey", F.col("a.line").alias("a_line"), F.col("b.line").alias("b_line"), fn.span_within("a.span", "b.span").alias("within"))


def united_records(spark, d):
    """Records of two adapters, once each; what one does not tell is null."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    return facts.union_records(s, c)


def native_report(spark, d):
    """The lines of a report with two sections and one that is empty."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"))
    return reports.envelope(spark, {"name": "assayer"}, {}, {"orders": o, "nations": n, "none": n.where("name IS NULL")}, n.select(F.col("name").alias("about")))


def test_symbols(spark, d):
    """Symbols are parts in 25 packages, tests are customers that refer to a part in full, by its name, or not."""
    p, c = read(spark, d, "part").select(F.col("p_partkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    package = F.concat(F.lit("m"), F.col("k") % 25)
    symbols = p.select(package.alias("package"), F.concat(package, F.lit("::t"), F.col("k") % 7, F.lit("::f"), F.col("k")).alias("symbol"))
    reference = F.when(F.col("k") % 3 == 0, F.concat(F.lit("t"), F.col("k") % 7, F.lit("::f"), F.col("k"))).when(F.col("k") % 3 == 1, F.concat(F.lit("crate::f"), F.col("k"))).otherwise(F.concat(F.lit("none"), F.col("k")))
    refs = c.select(package.alias("package"), F.concat(package, F.lit("::t"), F.col("c_nationkey") % 7, F.lit("::check")).alias("test"), reference.alias("reference"))
    return facts.best_symbols(refs, symbols)


def imported_mutants(spark, d):
    """A report of each supplier's order lines, in the form of one tool, read and checked. Lines of one
    number in an order are one mutant."""
    li = read(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("l_tax"))
    words = F.element_at(F.array(*(F.lit(w) for w in ("CaughtMutant", "MissedMutant", "Unviable", "Timeout", "Failure"))), F.col("l_linenumber") % 5 + 1)
    place = F.struct(F.struct(F.col("l_linenumber").alias("line"), (F.col("l_orderkey") % 80 + 1).alias("column")).alias("start"))
    name = F.concat(F.lit("replace == with != in "), F.concat_ws("-", "l_orderkey", "l_linenumber"))
    mutant = F.struct(name.alias("name"), F.concat(F.lit("./src//"), "l_suppkey", F.lit(".rs")).alias("file"), F.lit("!=").alias("replacement"), place.alias("span"))
    outcome = F.struct(F.struct(mutant.alias("Mutant")).alias("scenario"), words.alias("summary"), F.array(F.struct(F.lit(0.5).alias("duration")), F.struct(F.col("l_tax").cast("double").alias("duration"))).alias("phase_results"))
    texts = li.groupBy("l_suppkey").agg(F.to_json(F.struct(F.collect_list(outcome).alias("outcomes"))).alias("text"))
    rows = mutation_reports.checked(mutation_reports.cargo_mutants(texts), 1 << 62)
    return rows.select("file", "external_id", "line", "column", "original", "replacement", F.round("duration", 6).alias("duration"), "status", "operator")


def yagni_inventories(spark, d):
    f = part_functions(spark, d)
    identifiers = f.select("package", F.col("name").alias("identifier"), F.when(F.col("p_size") % 3 == 0, 2).otherwise(1).alias("production_references"))
    found = {rule: unused.unused_functions(f, identifiers, v, ["m3::f3", "m7.rs"]) for rule, v in (("unused-private-function", "private"), ("unreferenced-crate-export", "public"))}
    rows = catalog.yagni(found | {"unused-production-dependency": unused_dependencies(spark, d)}, {"unused-private-function": 7})
    return rows.select("rule_id", "violation_id", "file", "stable_symbol", "result", F.col("measured").cast("long").alias("measured"))


def supplier_cycles(spark, d):
    """Each supplier leads to one other, by its nation: chains that end in several cycles."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    many = s.agg(F.count("*").alias("many")).scalar()
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    edges = s.select(name(F.col("k")).alias("a"), name((F.col("k") * (F.col("n") + 1) + F.col("n")) % many + 1).alias("b"))
    return packages.cycles(edges).select(F.array_join("cycle", "|").alias("members"), F.size("cycle").alias("n"))


def offset_positions(spark, d):
    """Line and column of four places in each turn, found in one sweep a turn."""
    c = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("file"), F.col("text").alias("source"))
    n = F.char_length("source")
    offsets = c.select("file", F.explode(F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n)).alias("offset"))
    return reports.positions(offsets, c)


def kept_baseline(spark, d):
    """Two runs kept in buckets, and compared."""
    kept = {}
    for year in (1996, 1997):
        path = shared_path(spark, "run")
        kept[year] = engine.save_rules(yearly_rules(spark, d, year), f"run_{year}_{path.rpartition('-')[2]}", "orders", 8, path)
    return engine.with_baseline(kept[1997], kept[1996]).select("violation_id", "stable_symbol", "measured", "result", "excess", "baseline")


def exit_codes(spark, d):
    """Customers' runs: survivors, risk over the limit and the gate decide how a check ends."""
    k = F.col("o_orderkey")
    runs = read(spark, d, "orders").select("o_custkey", F.lit(True).alias("validated"), (k % 31 == 0).alias("timed_out"), (k % 3).cast("int").alias("exit_code"), (k % 5 == 0).alias("bad"))
    counts = mutation.mutation_exit(mutation.status_counts(mutation.classify_outcome(runs), "o_custkey")).select("o_custkey", F.col("exit_code").alias("mutation_exit"))
    gates = runs.groupBy("o_custkey").agg((F.count_if("bad") == 0).alias("gate"), F.count("*").alias("n"), F.count_if("timed_out").alias("missing"))
    met = counts.join(gates, "o_custkey")
    risk = mutation.risk_exit(F.col("n") == 1, F.col("o_custkey") % 2 == 0, F.col("missing"), F.lit(False), F.when(F.col("gate"), 0).otherwise(1))
    return met.select("o_custkey", "mutation_exit", mutation.check_exit(F.col("mutation_exit"), F.col("gate")).alias("check_exit"), risk.alias("risk_exit"))


def clone_group_sizes(spark, d):
    """The least words and lines of the members of each near-clone group."""
    arrays = word_arrays(spark, d).where(F.size("tokens") >= SHINGLE)
    classes = settle(clones.clone_classes(arrays))
    first = classes.where("file = representative").select("file")
    g = clones.near_groups(clones.near_pairs(clones.shingle_sets(arrays, SHINGLE), DICE, first), classes)
    sizes = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), words("text").alias("tokens"), F.size(F.split("text", "\n")).alias("statement_count"))
    return clones.group_measures(g, sizes).select("label", "token_count", "statement_count")


def regional_files(spark, d):
    """Hot files: every user's hours against blocks of two days, by cells."""
    blocks = event_lines(spark, d).select("file", F.floor(F.col("line") / 48).alias("n")).distinct()
    spans = blocks.select("file", F.col("n"), (F.col("n") * 48).alias("low"), (F.col("n") * 48 + 60).alias("high"))
    met = intervals.stab(event_lines(spark, d), "line", spans, "low", "high", ["file"])
    return met.groupBy("file", "n").agg(F.count("*").alias("lines"), F.sum("hits").alias("hits"))


QUERIES = {
    f.__name__: f
    for f in (
        mutant_symbols, mutant_numbers, numbered_rules, numbered_diagnostics, numbered_mutants, reported_groups, unresolved_mutants, policy_coverage, span_relations, united_records, native_report, test_symbols, imported_mutants,
        yagni_inventories, supplier_cycles, offset_positions, kept_baseline, exit_codes, clone_group_sizes, regional_files,
    )
}

