"""Report projections: native JSON, SARIF 2.1.0, Mutation Testing Elements v2, text."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.columns import STATUSES, escape_terminal, mutator_name, path_uri
from assayer.operators.graph import settle

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
MTE_STATUS = {"killed": "Killed", "survived": "Survived", "no-coverage": "NoCoverage", "compile-error": "CompileError", "runtime-error": "RuntimeError", "timeout": "Timeout", "ignored": "Ignored", "invalid": "RuntimeError", "pending": "Pending"}


def native_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object; null fields are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


#: The worst first.
SEVERITIES = ("error", "warning", "info")


def _rank(c: str, values: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), F.col(c))


def diagnostic_order() -> list[Column]:
    """Worst first, those without a place before those with one, then by place, backend, message and whether a
    fallback was used."""
    places = [F.col(c).asc_nulls_first() for c in ("file", "start_line", "start_column", "end_line", "end_column")]
    return [_rank("severity", SEVERITIES), *places, F.col("backend"), F.col("message"), F.col("fallback_used")]


def mutant_order() -> list[Column]:
    """By structure and place, then by outcome; what is not known comes first."""
    named = ("file", "stable_symbol", "operator", "fingerprint", "line", "column", "id", "original", "replacement")
    return [*map(F.col, named), _rank("status", STATUSES), *(F.col(c).asc_nulls_first() for c in ("exit_code", "detail", "duration"))]


CRAP_RESULT, DRY_RESULT = "crap-threshold", "duplicate-code"


def sarif_results(rules: DataFrame, functions: DataFrame | None = None, groups: DataFrame | None = None, limit: float = 6.0) -> DataFrame:
    """SARIF results: rule_id, level, message, places (array of uri, start_line, end_line), fingerprint.

    A report that has the risk section (``functions``: name, file, start_line, end_line, crap) shows its
    functions over the limit, and no failing row of a ``crap.`` rule; one that has the clone section
    (``groups``: number, token_count, locations of file, start_line, end_line) shows its groups, and no
    row of a ``dry.`` rule. All other failing rows with a file follow.
    """
    none = F.lit(None).cast("int")
    place = lambda uri, low, high: F.struct(uri.alias("uri"), low.alias("start_line"), high.alias("end_line"))
    span = lambda file, low, high: place(path_uri(file), F.greatest(low, F.lit(1)).cast("int"), F.greatest(high, low, F.lit(1)).cast("int"))
    text = F.concat(F.col("stable_symbol"), F.lit(": "), F.coalesce(F.col("measured").cast("string"), F.col("measured_flag").cast("string")), F.lit(" against "), F.coalesce(F.col("allowed").cast("string"), F.col("allowed_flag").cast("string"), F.lit("none")))
    told = rules.where("result = 'fail' AND file <> ''")
    if functions is not None:
        told = told.where(~F.startswith("rule_id", F.lit("crap.")))
    if groups is not None:
        told = told.where(~F.startswith("rule_id", F.lit("dry.")))
    parts = [told.select("rule_id", text.alias("message"), F.array(place(path_uri("file"), none, none)).alias("places"), F.col("violation_id").alias("fingerprint"))]
    if functions is not None:
        over = functions.where(F.col("crap") > limit)
        score = F.concat("name", F.lit(": risk "), F.format_string("%.2f", "crap"), F.lit(f" over {limit:.2f}"))
        parts.append(over.select(F.lit(CRAP_RESULT).alias("rule_id"), score.alias("message"), F.array(span(F.col("file"), F.col("start_line"), F.col("end_line"))).alias("places"), F.lit(None).cast("string").alias("fingerprint")))
    if groups is not None:
        size = F.concat(F.lit("group "), F.col("number").cast("string"), F.lit(": "), F.col("token_count").cast("string"), F.lit(" tokens in "), F.size("locations").cast("string"), F.lit(" places"))
        parts.append(groups.select(F.lit(DRY_RESULT).alias("rule_id"), size.alias("message"), F.transform("locations", lambda x: span(x["file"], x["start_line"], x["end_line"])).alias("places"), F.lit(None).cast("string").alias("fingerprint")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule_id", F.lit("warning").alias("level"), "message", "places", "fingerprint")


def sarif_rows(rules: DataFrame, functions: DataFrame | None = None, groups: DataFrame | None = None, limit: float = 6.0) -> DataFrame:
    """(rule_id, json): one SARIF result object for each result."""
    r = sarif_results(rules, functions, groups, limit)
    region = lambda p: F.when(p["start_line"].isNotNull(), F.struct(p["start_line"].alias("startLine"), p["end_line"].alias("endLine")))
    places = F.transform("places", lambda p: F.struct(F.struct(F.struct(p["uri"].alias("uri")).alias("artifactLocation"), region(p).alias("region")).alias("physicalLocation")))
    prints = F.when(F.col("fingerprint").isNotNull(), F.struct(F.col("fingerprint").alias("violationId/v1")))
    return r.select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), places.alias("locations"), prints.alias("partialFingerprints"))).alias("json"))


def document_lines(spark: SparkSession, parts: Sequence[str | DataFrame]) -> DataFrame:
    """(line): a JSON document whose parts are fixed text or tables of ``json`` rows.

    Rows of a table follow in the order of their JSON, with commas between them. Rows are ranged over the
    cluster and numbered within their range; no row passes through the driver, which only knows the text
    between the tables. ``write_document`` keeps the order.
    """
    tables = [p.select(F.lit(i).alias("part"), "json") for i, p in enumerate(parts) if not isinstance(p, str)]
    texts = spark.createDataFrame([(i, -1, p) for i, p in enumerate(parts) if isinstance(p, str)], "part int, at long, line string")
    if not tables:
        return texts.orderBy("part", "at").select("line")
    rows = reduce(lambda a, b: a.unionByName(b), tables)
    # written once: numbers grow with the order, range by range
    ordered = settle(rows.orderBy("part", "json").withColumn("at", F.monotonically_increasing_id()))
    first = ordered.groupBy("part").agg(F.min("at").alias("first"))  # one row a table
    body = ordered.join(F.broadcast(first), "part").select("part", "at", F.concat(F.when(F.col("at") > F.col("first"), ", ").otherwise(""), "json").alias("line"))
    return body.unionByName(texts).orderBy("part", "at").select("line")


def write_document(lines: DataFrame, path: str) -> None:
    """Write a document as text files whose names are in order: one after the other they are the document.
    Each task commits its own file."""
    lines.write.mode("overwrite").text(path)


def sarif_document(rules: DataFrame, tool: str = "assayer", functions: DataFrame | None = None, groups: DataFrame | None = None, limit: float = 6.0) -> DataFrame:
    """(line): the SARIF log."""
    rows = sarif_rows(rules, functions, groups, limit)
    sections = [CRAP_RESULT] * (functions is not None) + [DRY_RESULT] * (groups is not None)
    names = sections + sorted({r.rule_id for r in rows.select("rule_id").distinct().collect()} - set(sections))  # the catalog
    head = json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": tool, "rules": [{"id": n} for n in names]}) + '}, "results": ['
    return document_lines(rules.sparkSession, [head, rows.select("json"), "]}]}"])


def envelope(spark: SparkSession, tool: dict, request: dict, sections: dict[str, DataFrame], diagnostics: DataFrame | None = None, version: int = 1) -> DataFrame:
    """(line): the native report: schema version, tool, request, then each section's rows and the
    diagnostics, in the order of their JSON. Sections that were not taken are left out, empty ones are
    empty arrays."""
    head = json.dumps({"schema_version": version, "tool": tool, "request": request}, sort_keys=True)
    parts: list[str | DataFrame] = [head[:-1] + ', "results": {']
    for k, name in enumerate(sorted(sections)):
        parts += [(", " if k else "") + json.dumps(name) + ": [", native_rows(sections[name]), "]"]
    parts.append('}, "diagnostics": [')
    return document_lines(spark, [*parts, *([] if diagnostics is None else [native_rows(diagnostics)]), "]}"])


def position(text: str, offset: str) -> tuple[Column, Column]:
    """(line, column), from 1, of a character offset: breaks before it, and characters since the last."""
    before = F.substring(F.col(text), F.lit(1), F.col(offset))
    last = F.substring_index(before, "\n", -1)
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line.alias("line"), (F.char_length(last) + 1).alias("column")


def positions(offsets: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, offset, line, column), from 1, of the distinct character offsets of each file.

    ``offsets``: file, offset; ``sources``: file, source. The starts of a source's lines are found once, and
    offsets take the last start before them in one sweep over both; no text is cut for an offset.
    """
    rows = sources.select("file", F.posexplode(F.split("source", "\n")).alias("row", "text"))
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("file", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).alias("at"), (F.col("row") + 1).alias("line"))
    asked = offsets.select("file", F.col("offset").cast("long").alias("at")).distinct()
    both = starts.withColumn("start", F.col("at")).unionByName(asked.withColumns({"line": F.lit(None).cast("int"), "start": F.lit(None).cast("long")}))
    # at one place the line comes first
    sweep = Window.partitionBy("file").orderBy("at", F.col("line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.select("file", F.col("at").alias("offset"), "start", F.last("line", ignorenulls=True).over(sweep).alias("line"), F.last("start", ignorenulls=True).over(sweep).alias("since"))
    return told.where("start IS NULL AND line IS NOT NULL").select("file", "offset", "line", (F.col("offset") - F.col("since") + 1).cast("int").alias("column"))


def mutation_elements(results: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, json): the MTE file object of each source with its mutants.

    ``results``: file, id, original, replacement, start, end (character offsets), status, duration.
    ``sources``: file, language, source.
    """
    status = F.when(F.lit(False), "")
    for k, v in MTE_STATUS.items():
        status = status.when(F.col("status") == k, v)
    ends = results.select("file", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("offset"))
    at = positions(ends, sources)
    place = lambda name: at.select("file", F.col("offset").alias(name), F.struct("line", "column").alias(f"{name}_at"))
    r = results.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")}).join(place("start"), ["file", "start"]).join(place("end"), ["file", "end"])
    where = F.struct(F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    m = r.select("file", F.struct(F.col("id").cast("string").alias("id"), mutator_name("original", "replacement").alias("mutatorName"), "replacement", where.alias("location"), status.alias("status"), "duration").alias("m"))
    mutants = m.groupBy("file").agg(F.array_sort(F.collect_list("m")).alias("mutants"))
    return sources.join(mutants, "file").select("file", F.to_json(F.struct("language", "source", "mutants")).alias("json"))


def _number(c, suffix: str = "") -> Column:
    return F.when(F.col(c).isNotNull(), F.concat(F.format_string("%.2f", F.col(c).cast("double")), F.lit(suffix))).otherwise("unknown")


def human_lines(rules: DataFrame | None = None, functions: DataFrame | None = None, groups: DataFrame | None = None, mutants: DataFrame | None = None, limit: float = 6.0) -> DataFrame:
    """(line): the report as text. A section that was taken has a line with its counts, then its rows in the
    order of the report: functions by risk, groups by number, mutants by place, failing rules by id.
    Control and direction marks of names are escaped.

    ``functions``: file, start_line, name, complexity, coverage, crap; ``groups``: number, token_count,
    locations (array of file, start_line, end_line); ``mutants``: file, line, column, id, original,
    replacement, status.
    """
    parts = []

    def section(rows: DataFrame, head: Column, line: Column, *order: Column | str) -> None:
        """``head`` counts over all rows; rows stand in ``order``."""
        k = len(parts)
        ranked = settle(rows.orderBy(*order).select(line.alias("line")).withColumn("at", F.monotonically_increasing_id()))
        parts.append(rows.agg(head.alias("line")).select(F.lit(2 * k).alias("part"), F.lit(0).cast("long").alias("at"), "line"))
        parts.append(ranked.select(F.lit(2 * k + 1).alias("part"), "at", "line"))

    text = lambda *cs: F.concat(*(F.coalesce(c.cast("string"), F.lit("")) if isinstance(c, Column) else F.lit(c) for c in cs))
    if functions is not None:
        over = F.count_if(F.col("crap") > limit)
        head = text("risk: ", F.count("*"), " functions, ", over, f" over {limit:.2f}, ", F.count_if(F.col("crap").isNull()), " without coverage")
        line = text("  ", escape_terminal("file"), ":", F.col("start_line"), " ", escape_terminal("name"), "  complexity ", F.col("complexity"), ", coverage ", _number("coverage", "%"), ", risk ", _number("crap"))
        section(functions, head, line, F.col("crap").desc_nulls_last(), "file", "start_line", "name")
    if groups is not None:
        spots = F.array_join(F.transform("locations", lambda x: F.concat(escape_terminal(x["file"]), F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"))), ", ")
        section(groups, text("clones: ", F.count("*"), " groups"), text("  ", F.col("number"), ": ", F.col("token_count"), " tokens in ", spots), "number")
    if mutants is not None:
        head = text("mutants: ", F.count("*"), ", ", F.count_if(F.col("status") == "killed"), " killed, ", F.count_if(F.col("status") == "survived"), " survived")
        line = text("  ", escape_terminal("file"), ":", F.col("line"), ":", F.col("column"), " #", F.col("id"), " ", escape_terminal("original"), " -> ", escape_terminal("replacement"), " ", F.col("status"))
        section(mutants, head, line, "file", "line", "column", "id")
    if rules is not None:
        head = text("rules: ", F.count("*"), " evaluated, ", F.count_if(F.col("result") == "fail"), " failed")
        line = F.concat_ws("  ", F.lit(""), "rule_id", escape_terminal("file"), escape_terminal("stable_symbol"), F.coalesce(F.col("measured").cast("string"), F.col("measured_flag").cast("string")))
        section(rules, head, F.when(F.col("result") == "fail", line), "rule_id", "file", "stable_symbol", "violation_id")
        parts[-1] = parts[-1].where("line IS NOT NULL")
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("part", "at").select("line")
