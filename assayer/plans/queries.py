"""Queries that bind the operators to the driver's tables.

The tables hold no source code; each query says what stands in for which fact. Every query runs over
its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import columns as fn
from assayer.operators import clones, cohesion, coverage, mutation, packages, unused
from assayer.operators.graph import settle, settle_lines
from assayer.rules import catalog, engine
from assayer.sinks import reports
from assayer.sources import coverage_reports, python_facts

Query = Callable[[SparkSession, str], DataFrame]
WINDOW, SHINGLE, DICE, CAP = 30, 4, 0.92, 100
SEED, MAXIMUM = 76412026, 1000


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the table has fewer splits than there are cores: one small file
    would else keep one core busy. Tables of many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# functions from order lines: complexity, coverage
def scored_lines(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 1000).alias("coverage"))
    return li.withColumn("crap", fn.crap_score("l_linenumber", "coverage"))


def crap_score(spark, d):
    return scored_lines(spark, d).select("l_orderkey", "l_linenumber", F.round("crap", 6).alias("crap"))


def risk_summary(spark, d):
    return coverage.risk_summary(scored_lines(spark, d).withColumn("crap", F.round("crap", 6)))


# coverage lines from events: file = user, line = hour of the month, hits = events that are no errors
def event_lines(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("line"), (F.col("event_type") != "error").cast("int").alias("hit"))
    return e.groupBy("file", "line").agg(F.sum("hit").alias("hits"))


def day_functions(spark, d, width: int, step: int = 24):
    """One function for each user and day: ``width`` hours from its start, with an excluded range."""
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.dayofmonth("ts").alias("day")).distinct()
    f = e.select("file", F.concat("file", F.lit("#"), "day").alias("function_id"), (F.col("day") * step).alias("start_line"), (F.col("day") * step + width - 1).alias("end_line"), (F.col("day") % 7 + 1).alias("complexity"))
    return f.withColumn("excluded", F.array(F.struct((F.col("start_line") + 5).alias("s"), (F.col("start_line") + 8).alias("e"))))


def line_coverage(spark, d):
    out = coverage.apply_coverage(day_functions(spark, d, 24), event_lines(spark, d))
    return out.select("function_id", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("executable", F.lit(0)).alias("executable"), "reason", F.round("coverage", 6).alias("coverage"), F.round("crap", 6).alias("crap"))


def coverage_counters(spark, d):
    return coverage.application_counters(coverage.apply_coverage(day_functions(spark, d, 24), event_lines(spark, d)))


def ambiguous_lines(spark, d):
    owned = coverage.owned_lines(day_functions(spark, d, 30), event_lines(spark, d))
    return coverage.ambiguous_functions(owned)


def enclosing_function(spark, d):
    """Each event in the smallest of its user's blocks of 6, 24 and 96 hours."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("hour"))
    sizes = F.explode(F.array(*map(F.lit, (6, 24, 96))))
    blocks = e.select("file", "hour", sizes.alias("size")).select("file", "size", F.floor(F.col("hour") / F.col("size")).alias("n")).distinct()
    f = blocks.select("file", (F.col("n") * F.col("size")).alias("start_line"), (F.col("n") * F.col("size") + F.col("size") - 1).alias("end_line"), F.concat_ws(":", "size", "n").alias("name"))
    f = f.withColumns({"stable_symbol": F.col("name"), "function_id": F.concat_ws("/", "file", "name")})
    points = e.select(F.col("event_id").alias("point_id"), "file", F.col("hour").alias("start_line"), F.col("hour").alias("end_line"))
    return coverage.smallest_container(points, f).select(F.col("point_id").alias("event_id"), "symbol")


def file_resolution(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"//([^/]+)", 1).alias("host"), F.regexp_extract("url", r"//[^/]+/([^?#]*)", 1).alias("path"))
    files = p.select(F.col("path").alias("file"))
    reported = p.select(F.concat_ws("/", "host", "path").alias("file"))
    return coverage.resolve_files(files, reported)


def lcov_round_trip(spark, d):
    """A report made of the event lines, one record a file, written and read in records."""
    rows = event_lines(spark, d).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "hits"))).alias("x"))
    text = F.concat(F.lit("TN:\nSF:src/"), F.col("file"), F.lit(".c\n"), F.array_join(F.transform("x", lambda x: F.concat(F.lit("DA:"), x["line"], F.lit(","), x["hits"])), "\n"), F.lit("\nend_of_record"))
    return coverage_reports.lcov(spark, settle_lines(rows.select(text.alias("text")), "lcov"))


def coverage_json_round_trip(spark, d):
    rows = event_lines(spark, d).groupBy("file").agg(F.collect_list(F.when(F.col("hits") > 0, F.col("line"))).alias("a"), F.collect_list(F.when(F.col("hits") == 0, F.col("line"))).alias("b"))
    text = F.to_json(F.struct(F.create_map(F.concat(F.lit("./src//"), "file"), F.struct(F.col("a").alias("executed_lines"), F.col("b").alias("missing_lines"))).alias("files")))
    return coverage_reports.coverage_py(rows.select(text.alias("text")))


# packages are nations, dependencies lead from a supplier's nation to a customer's
def graph(spark, d):
    n = read(spark, d, "nation")
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "b")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = li.groupBy("a", "b").agg(F.count("*").alias("n"))
    mean = e.agg(F.avg("n").alias("mean"))
    e = e.withColumn("scope", F.when(F.col("n") > 1.3 * mean.scalar(), "production").otherwise("development"))
    x, y = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("package"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("dependency"), F.col("n_regionkey").alias("rb"))
    # a package graph is used many times over, and is small beside the lines that it comes from
    e = settle(e.join(x, "a").join(y, "b").select("package", "dependency", "scope", F.lit(True).alias("internal"), (F.col("ra") == F.col("rb")).alias("target_gated")))
    return n.select(F.col("n_name").alias("name"), F.concat(F.lit("crates/"), F.col("n_name")).alias("root"), "n_regionkey"), e


def coupling(spark, d):
    p, e = graph(spark, d)
    return packages.coupling(p, e).select("name", "afferent", "efferent", F.round("instability", 9).alias("instability"))


def package_cycles(spark, d):
    p, e = graph(spark, d)
    i = packages.internal_edges(p, e)
    return packages.cycles(i.select(F.col("package").alias("a"), F.col("dependency").alias("b"))).select(F.array_join("cycle", "|").alias("members"), F.size("cycle").alias("n"))


def layer_directions(spark, d):
    p, e = graph(spark, d)
    layers = p.select(F.col("name").alias("pattern"), F.col("n_regionkey").alias("layer"))
    return packages.edge_directions(packages.internal_edges(p, e), layers).select("package", "dependency", "source_layer", "target_layer", "passed")


def forbidden_edges(spark, d):
    p, e = graph(spark, d)
    return packages.forbidden_edges(packages.internal_edges(p, e), ["NATION_1*->*2", "*3->*"]).select("package", "dependency", "passed")


def coupling_rules(spark, d):
    p, e = graph(spark, d)
    rows = catalog.coupling(p, e).unionByName(catalog.dependency_counts(p, e))
    return rows.select("rule_id", "violation_id", "file", "stable_symbol", F.round("measured", 9).alias("measured"), "allowed", "result", F.round("excess", 9).alias("excess"))


# mutants are order lines; their status follows the two flags
STATUS_OF = {"AF": "killed", "RF": "survived", "NF": "timeout", "NO": "pending"}


def mutant_lines(spark, d):
    li = read(spark, d, "lineitem")
    flags = F.concat("l_returnflag", "l_linestatus")
    status = F.when(F.lit(False), "")
    for k, v in STATUS_OF.items():
        status = status.when(flags == k, v)
    original = F.element_at(F.array(*map(F.lit, ORIGINALS)), F.col("l_linenumber") % len(ORIGINALS) + 1)
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", status.otherwise("ignored").alias("status"), original.alias("original"))


ORIGINALS = ("==", "<", "&&", "+", "true", "%", "or")


def mutation_summary(spark, d):
    return mutation.status_counts(mutant_lines(spark, d), "original")


def mutation_score(spark, d):
    return mutation.mutation_score(mutant_lines(spark, d), "l_suppkey").withColumn("score", F.round("score", 9))


def mutation_operators(spark, d):
    m = mutant_lines(spark, d).withColumn("replacement", fn.mutation_replacement(F.when(F.col("l_suppkey") % 2 == 0, "python").otherwise("c"), "original"))
    m = m.withColumns({"operator": fn.mutation_operator("original"), "mutator": fn.mutator_name("original", "replacement")})
    return m.groupBy("original", "replacement", "operator", "mutator").agg(F.count("*").alias("n"))


def mutant_fingerprints(spark, d):
    m = mutant_lines(spark, d).withColumns({"file": F.concat(F.lit("src/"), F.col("l_suppkey"), F.lit(".rs")), "stable_symbol": F.concat(F.lit("f"), F.col("l_linenumber")), "operator": fn.mutation_operator("original"), "replacement": F.lit("!="), "fingerprint": F.lit("")})
    m = m.withColumns({"line": F.col("l_orderkey"), "column": F.col("l_linenumber"), "start_byte": F.lit(0), "end_byte": F.lit(0)})
    return mutation.fingerprints(m).select("l_orderkey", "l_linenumber", "fingerprint")


def seeded_selection(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.lit("comparison").alias("operator"), F.lit("a.rs").alias("file"), F.lit("f").alias("stable_symbol"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("fingerprint"))
    chosen = mutation.limit_execution(mutation.select_candidates(o, ["comparison"], SEED), MAXIMUM)
    return chosen.select("o_orderkey", "seeded_key", "status")


# files are documents, tokens their words
def words(text: str) -> F.Column:
    return F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda x: x != "")


def word_arrays(spark, d):
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("string").alias("file"), words("text").alias("tokens"))


def exact_windows(spark, d):
    return clones.window_buckets(clones.candidate_windows(word_arrays(spark, d), WINDOW))


def maximal_regions(spark, d):
    return clones.maximal_regions(clones.candidate_windows(word_arrays(spark, d), WINDOW, CAP), WINDOW, CAP)


def near_clones(spark, d):
    """Links between files of different texts; ``clone_classes`` has the copies of each."""
    arrays = word_arrays(spark, d)
    first = clones.clone_classes(arrays).where("file = representative").select("file")
    pairs = clones.near_pairs(clones.shingle_sets(arrays, SHINGLE), DICE, first)
    return pairs.withColumn("similarity", F.round("similarity", 9))


def clone_classes(spark, d):
    return clones.clone_classes(word_arrays(spark, d))


def clone_groups(spark, d):
    arrays = word_arrays(spark, d).where(F.size("tokens") >= SHINGLE)
    classes = settle(clones.clone_classes(arrays))
    first = classes.where("file = representative").select("file")
    g = clones.near_groups(clones.near_pairs(clones.shingle_sets(arrays, SHINGLE), DICE, first), classes)
    return g.select("label", F.size("members").alias("members"), F.round("similarity", 9).alias("similarity"))


# owners are conversations, functions their turns, references the words
def turns(spark, d):
    c = read(spark, d, "conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return c.select(F.concat(F.lit("conv/"), "conv_id").alias("file"), F.concat_ws(":", "conv_id", "turn").alias("function_id"), F.lit("turn").alias("name"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("::t"), F.col("turn")).alias("stable_symbol"), words.alias("references"), F.lit(True).alias("structural_metrics_reliable"))


def module_cohesion(spark, d):
    return cohesion.module_cohesion(turns(spark, d)).select("file", "owner", "functions", "related", F.round("cohesion", 9).alias("cohesion"))


def cohesion_rules(spark, d):
    return catalog.cohesion_rows(turns(spark, d)).select("rule_id", "violation_id", "file", F.round("measured", 9).alias("measured"), "result")


def identifier_counts(spark, d):
    """Uses of each word by assistants (production) and by all others (test); a turn is a file."""
    c = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("file"), "role", "text")
    words = c.select("file", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("value"))
    files = c.select("file", F.lit("all").alias("package"), (F.col("role") != "assistant").alias("test"))
    return python_facts.identifier_counts(words, files)


def unused_items(spark, d):
    """Modules are parts, a reference is a line shipped in the last quarter of the data."""
    li = read(spark, d, "lineitem")
    last = li.agg(F.max("l_shipdate").alias("m"))
    used = li.where(F.col("l_shipdate") > F.date_sub(last.scalar(), 90).cast("timestamp")).groupBy("l_partkey").agg(F.count("*").alias("references"))
    p = read(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    no = F.lit(False)
    m = p.select(F.concat(F.lit("parts/"), "p_partkey").alias("file"), F.concat(F.lit("part::"), "p_partkey").alias("stable_symbol"), F.when(F.col("p_size") > 45, "public").otherwise("private").alias("visibility"), F.coalesce("references", F.lit(0)).alias("references"), no.alias("generated"), no.alias("framework_managed"), no.alias("reflection_reachable"), no.alias("externally_invoked"), no.alias("target_gated"))
    rows = engine.bounded_inventory(unused.unused_modules(m), "yagni.unused-module", 0)
    return rows.select("rule_id", "violation_id", "file", "stable_symbol", F.col("measured").cast("long").alias("measured"), "result")


def contract_tests(spark, d):
    """Implementations are documents, the contract their language; a label of good quality is the test."""
    docs = read(spark, d, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("file"), F.col("lang").alias("trait_symbol"), F.col("doc_id").cast("string").alias("implementation_symbol"), F.lit(False).alias("target_gated"))
    tests = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    tests = tests.select(F.lit(False).alias("target_gated"), F.when(F.col("quality") == 1, F.array(F.lit("contract"))).otherwise(F.array(F.lit("plain"))).alias("markers"), F.array(F.col("lang"), F.col("doc_id").cast("string")).alias("referenced_symbols"))
    rows = catalog.contracts(docs, tests, ["en", "de"], "contract")
    return rows.select("violation_id", "file", "stable_symbol", "measured_flag", "result")


# functions are orders
def order_functions(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("complexity"), F.max("l_linenumber").alias("nesting_depth"), F.sum("l_quantity").cast("long").alias("statement_count"), F.count_distinct("l_returnflag", "l_linestatus").alias("parameter_count"))
    return li.select(F.concat(F.lit("o/"), "l_orderkey").alias("file"), F.lit("f").alias("name"), F.lit("").alias("stable_symbol"), F.lit(True).alias("structural_metrics_reliable"), "complexity", "nesting_depth", "statement_count", "parameter_count")


def kiss_rules(spark, d):
    return catalog.kiss(order_functions(spark, d), complexity=5, parameters=2).select("rule_id", "violation_id", "file", "stable_symbol", "measured", "allowed", "result", "excess")


def rule_summary(spark, d):
    rows = catalog.kiss(order_functions(spark, d), complexity=5, parameters=2)
    return engine.summary(rows)


def yearly_rules(spark, d, year: int):
    """A rule row for each customer: orders of a year against a limit."""
    o = read(spark, d, "orders").where(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return engine.rule_rows(o, "load.orders", F.concat(F.lit("c/"), "o_custkey"), F.col("o_custkey").cast("string"), "maximum", "orders-v1", F.col("n"), 1)


def baseline_diff(spark, d):
    rows = engine.with_baseline(yearly_rules(spark, d, 1997), yearly_rules(spark, d, 1996))
    return rows.select("violation_id", "stable_symbol", "measured", "result", "excess", "baseline")


def baseline_resolved(spark, d):
    none = spark.createDataFrame([], "rule_id string")
    return engine.resolved(yearly_rules(spark, d, 1997), yearly_rules(spark, d, 1996), none).select("violation_id", "stable_symbol")


def path_functions(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"//(.*)$", 1).alias("u"))
    return p.select("page_id", fn.repository_path(F.concat(F.lit("./a//"), "u")).alias("repository"), fn.coverage_path(F.concat(F.lit("/x/../"), "u")).alias("report"), fn.path_uri("u").alias("uri"), fn.stable_id(F.lit("r"), "u", F.lit("é"), "u").alias("id"))


def symbol_functions(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("crate::m"), F.col("s_nationkey"), F.lit("::Type."), F.translate("s_name", "#", "_"), F.lit("(a: (u8, u8))#0123456789ab:2")).alias("s"))
    return s.select("s_suppkey", fn.bare_symbol("s").alias("bare"), fn.simple_name("s").alias("name"), fn.cohesion_owner("s", F.lit("f")).alias("owner"), F.array_join(fn.reference_segments("s"), "|").alias("segments"), fn.encoded_components(fn.reference_segments("s")).alias("encoded"))


def text_positions(spark, d):
    """Line and column of the middle of each turn."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text", F.floor(F.char_length("text") / 2).cast("int").alias("at"))
    return c.select("conv_id", "turn", *reports.position("text", "at"))


def sarif_results(spark, d):
    rows = catalog.kiss(order_functions(spark, d), complexity=5, parameters=2)
    return reports.sarif_results(rows).select("rule_id", "level", F.col("places")[0]["uri"].alias("uri"), "fingerprint")


def finding_groups(spark, d):
    """Independent clone groups, of all places of all windows, need an order over all groups of a run; no SQL form."""
    arrays = word_arrays(spark, d)
    places = clones.repeated_places(clones.candidate_windows(arrays, WINDOW, CAP), WINDOW, CAP)
    g = clones.place_groups(places, arrays).withColumn("group_id", F.sha2(F.concat(F.col("token_count").cast("string"), F.lit(":"), F.col("evidence")), 256))
    g = g.withColumn("places", F.transform("locations", lambda x: F.struct(x["file"].alias("file"), x["start"].alias("start_line"), (x["start"] + F.col("token_count") - 1).alias("end_line"))))
    return clones.independent_groups(g.select("group_id", "token_count", "places")).select("group_id", "token_count", F.size("places").alias("places"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        crap_score, risk_summary, line_coverage, coverage_counters, ambiguous_lines, enclosing_function, file_resolution, lcov_round_trip, coverage_json_round_trip,
        coupling, package_cycles, layer_directions, forbidden_edges, coupling_rules, mutation_summary, mutation_score, mutation_operators, mutant_fingerprints, seeded_selection,
        exact_windows, maximal_regions, near_clones, clone_classes, clone_groups, module_cohesion, cohesion_rules, identifier_counts, unused_items, contract_tests, kiss_rules, rule_summary,
        baseline_diff, baseline_resolved, path_functions, symbol_functions, text_positions, sarif_results, finding_groups,
    )
}
