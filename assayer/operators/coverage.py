"""Risk scores: functions joined to line coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import coverage_path, coverage_percent, crap_score
from assayer.operators.intervals import greatest_stretches, stab, with_point_cells, with_span_cells


def merge_lines(*reports: DataFrame) -> DataFrame:
    """Union of (file, line, hits): the most hits of a line win."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.groupBy("file", "line").agg(F.max("hits").alias("hits"))


def _tails(c) -> Column:
    """The path itself, then what follows each of its slashes."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


#: A path that passes through more links than this is taken for a loop and stays as it is.
LINKS = 8


def _canonical(met: DataFrame, reported: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` (rel, joined) with canonical: the reported path that ``joined`` truly is."""
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/"))
    to = links.select(coverage_path("path").alias("prefix"), coverage_path("target").alias("target"))
    now = met.select("rel", F.col("joined").alias("path"))
    for _ in range(LINKS):  # each step reads the one before it once
        met_links = now.select("rel", "path", F.explode(prefixes(F.col("path"))).alias("prefix")).join(to, "prefix", "left")
        best = met_links.groupBy("rel", "path").agg(F.max_by(F.struct("prefix", "target"), F.when(F.col("target").isNotNull(), F.length("prefix"))).alias("at"))
        now = best.select("rel", F.coalesce(F.concat("at.target", F.expr("substring(path, length(at.prefix) + 1)")), F.col("path")).alias("path"))
    known = reported.select(F.col("reported").alias("path"), F.col("reported").alias("canonical"))
    return met.join(now.join(known, "path").select("rel", "canonical"), "rel", "left")


def resolve_files(files: DataFrame, reported: DataFrame, root: str = "", links: DataFrame | None = None) -> DataFrame:
    """(file, reported): the report's path of each file. The first way that finds one wins: the same
    path, the path below ``root``, the true path of that where ``links`` (path, target of links among
    folders or files) leads elsewhere, the only path of which one is the other's suffix, the only path
    with that base name.

    The true path is that of the longest linked prefix, looked up by equality of prefixes; a target may
    lie below another link, as often as ``LINKS`` times.

    A path has as many suffixes as parts, so candidates meet by equality; for a suffix or base name
    only the number of paths and the least of them are kept, so a common name makes no pairs.
    """
    f = files.select("file").distinct().withColumn("rel", coverage_path("file"))
    r = reported.select(F.col("file").alias("reported")).distinct()
    same = r.select(F.col("reported").alias("rel"), F.col("reported").alias("same"))
    below = r.select(F.col("reported").alias("joined"), F.col("reported").alias("below"))
    longer = r.select(F.explode(_tails(F.col("reported"))).alias("rel"), "reported").groupBy("rel").agg(F.count("*").alias("n_longer"), F.min("reported").alias("longer"))
    tails = f.select("rel", F.explode(F.slice(_tails(F.col("rel")), F.lit(2), F.size(_tails(F.col("rel"))))).alias("reported")).distinct()
    shorter = tails.join(r, "reported").groupBy("rel").agg(F.count("*").alias("n_shorter"), F.min("reported").alias("shorter"))
    named = r.groupBy(F.substring_index("reported", "/", -1).alias("base")).agg(F.count("*").alias("n_named"), F.min("reported").alias("named"))
    met = f.join(same, "rel", "left").withColumn("joined", F.concat(F.lit(root.rstrip("/") + "/"), F.col("rel"))).join(below, "joined", "left")
    met = _canonical(met, r, links) if links is not None else met.withColumn("canonical", F.lit(None).cast("string"))
    met = met.join(longer, "rel", "left").join(shorter, "rel", "left").withColumn("base", F.substring_index("rel", "/", -1)).join(named, "base", "left")
    n = F.coalesce("n_longer", F.lit(0)) + F.coalesce("n_shorter", F.lit(0))
    found = F.coalesce("same", "below", "canonical", F.when(n == 1, F.coalesce("longer", "shorter")), F.when((n == 0) & (F.col("n_named") == 1), F.col("named")))
    return met.select("file", found.alias("reported")).where("reported IS NOT NULL")


def owned_lines(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Each executable line of a function: within its range, not strictly inside an excluded range.

    ``functions``: function_id, file, start_line, end_line, excluded (array of struct(s, e)). A line and a
    function meet in a dyadic cell, which carries only the excluded ranges that reach into it.
    """
    f = functions.select("function_id", "file", "start_line", "end_line", F.coalesce("excluded", F.array().cast("array<struct<s:int,e:int>>")).alias("excluded"))
    cells = with_span_cells(f, "start_line", "end_line")
    first = F.call_function("shiftleft", F.col("cell"), F.col("level"))
    last = F.call_function("shiftleft", F.col("cell") + 1, F.col("level")) - 1
    cells = cells.select("function_id", "file", "level", "cell", F.filter("excluded", lambda r: (r.s < last) & (first < r.e)).alias("excluded"))
    points = with_point_cells(lines.select("file", "line", "hits"), "line", f, "start_line", "end_line")
    free = ~F.exists("excluded", lambda r: (r.s < F.col("line")) & (F.col("line") < r.e))
    return points.join(cells, ["file", "level", "cell"]).where(free).select("function_id", "file", "line", "hits")


def boundary_executable(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """function_id of functions with an executable line on the edge of an excluded range."""
    edges = functions.select("function_id", "file", "start_line", "end_line", F.explode("excluded").alias("r")).select("function_id", "file", "start_line", "end_line", F.explode(F.array("r.s", "r.e")).alias("line"))
    edges = edges.where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return edges.join(lines.select("file", "line"), ["file", "line"], "left_semi").select("function_id").distinct()


def ambiguous_functions(owned: DataFrame) -> DataFrame:
    """function_id of functions that share an executable line."""
    shared = owned.groupBy("file", "line").agg(F.count("*").alias("n")).where("n > 1")
    return owned.join(shared, ["file", "line"], "left_semi").select("function_id").distinct()


def line_counts(owned: DataFrame) -> DataFrame:
    return owned.groupBy("function_id").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("executable"))


def smallest_container(points: DataFrame, functions: DataFrame, point_id: str = "point_id") -> DataFrame:
    """Each point (file, start_line, end_line) with the smallest function that contains it; null if none.

    Ties go to the lesser symbol, then name. The least of a struct is an aggregate with partial sums.
    """
    f = functions.select("file", F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"), F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("stable_symbol").alias("symbol"), "name", "function_id").alias("k"))
    hits = stab(points.select(point_id, "file", "start_line", "end_line"), "start_line", f, "f_start", "f_end", ["file"])
    hits = hits.where(F.col("end_line") <= F.col("f_end")).select(point_id, "file", "k")
    # points without a function come from the points themselves: one grouping, no join back
    every = points.select(point_id, "file").withColumn("k", F.lit(None).cast(hits.schema["k"].dataType))
    return hits.unionByName(every).groupBy(point_id, "file").agg(F.min("k").alias("k")).select(point_id, "file", "k.function_id", F.col("k.symbol").alias("symbol"))


def regional_percent(regions: DataFrame) -> DataFrame:
    """(function_id, start_line, end_line, hits) of assigned regions -> coverage; where regions overlap, a
    line has the most hits. Rows grow with regions: lines are counted by the length of stretches."""
    merged = greatest_stretches(regions.select("function_id", "start_line", "end_line", "hits"), ["function_id"])
    lines = F.col("end_line") - F.col("start_line") + 1
    counts = merged.groupBy("function_id").agg(F.sum(F.when(F.col("hits") > 0, lines).otherwise(0)).alias("covered"), F.sum(lines).alias("executable"))
    return counts.select("function_id", coverage_percent("covered", "executable").alias("coverage"))


def apply_coverage(functions: DataFrame, lines: DataFrame, unreported_as_zero: bool = False, has_regions: bool = False) -> DataFrame:
    """coverage, crap and reason of each function; a function without a score says why.

    reason: matched, unmatched-file, ambiguous or empty-range. A missing file counts as zero only where
    the policy asks for it and the report has function regions.
    """
    owned = owned_lines(functions, lines)
    doubt = boundary_executable(functions, lines).unionByName(ambiguous_functions(owned)).distinct().withColumn("doubt", F.lit(True))
    known = lines.select("file").distinct().withColumn("known", F.lit(True))
    out = functions.join(line_counts(owned), "function_id", "left").join(doubt, "function_id", "left").join(known, "file", "left")
    zero = F.lit(unreported_as_zero and has_regions)
    invalid = (F.col("start_line") == 0) | (F.col("end_line") < F.col("start_line"))
    reason = F.when(F.col("known").isNull(), F.when(zero, "matched").otherwise("unmatched-file")).when(invalid, "empty-range").when(F.col("doubt").isNotNull(), "ambiguous").when(F.col("executable").isNull(), "empty-range").otherwise("matched")
    coverage = F.when(F.col("known").isNull() & zero, 0.0).when(reason == "matched", coverage_percent("covered", "executable"))
    out = out.withColumns({"reason": reason, "coverage": coverage}).withColumn("crap", crap_score("complexity", "coverage"))
    return out.drop("known", "doubt")


def reason_counts() -> dict[str, Column]:
    """The counters of an application, as aggregates: for ``application_counters`` or to be observed."""
    names = {"matched_functions": "matched", "unmatched_functions": "unmatched-file", "empty_ranges": "empty-range", "ambiguous_functions": "ambiguous"}
    return {name: F.count_if(F.col("reason") == reason) for name, reason in names.items()}


def application_counters(applied: DataFrame) -> DataFrame:
    return applied.agg(*(c.alias(name) for name, c in reason_counts().items()))


def risk_summary(applied: DataFrame, threshold: float = 6.0) -> DataFrame:
    return applied.agg(F.count_if(F.col("crap") > threshold).alias("over_threshold"), F.count_if(F.col("crap").isNull()).alias("missing_coverage"), F.max("crap").alias("max_score"))


def risk_order() -> tuple:
    """Riskiest first, functions without a score last."""
    return F.col("crap").desc_nulls_last(), "file", "start_line", "name"


def sort_by_risk(applied: DataFrame) -> DataFrame:
    return applied.orderBy(*risk_order())
