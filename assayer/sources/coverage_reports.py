"""Coverage reports as tables of (file, line, hits).

Formats with records are read in records, so that a report of any size is read in many tasks: an LCOV
record ends at ``end_of_record``, a Cobertura class at its end tag. The JSON formats are one value each;
their readers go over a column of report texts (``path``, ``text``), many reports at once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.columns import coverage_path
from assayer.operators.coverage import merge_lines
from assayer.operators.intervals import greatest_stretches


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole files, through Spark's readers."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.decode("content", "UTF-8").alias("text"))


def read_records(spark: SparkSession, end: str, *paths: str) -> DataFrame:
    """(path, record) of files cut after each ``end``, which is left out. Spark splits a file among tasks
    and takes care of records across its splits."""
    return spark.read.option("lineSep", end).text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))


def lcov(spark: SparkSession, *paths: str) -> DataFrame:
    """``SF:`` names the file for the ``DA:`` lines up to ``end_of_record``; native expressions, no order
    over records."""
    records = read_records(spark, "\nend_of_record", *paths)
    # a record without its end may hold several files
    sections = records.select(F.explode(F.slice(F.split("record", "(?:^|\n)SF:"), F.lit(2), F.lit(1 << 30))).alias("section"))
    rows = sections.select(F.regexp_replace(F.substring_index("section", "\n", 1), "\r$", "").alias("name"), F.explode(F.split("section", "\r?\n")).alias("row"))
    rows = rows.where(F.startswith("row", F.lit("DA:")) & (F.col("name") != ""))
    part = F.split(F.substring("row", F.lit(4), F.char_length("row")), ",")
    return merge_lines(rows.select(coverage_path("name").alias("file"), F.trim(part[0]).cast("int").alias("line"), F.trim(part[1]).cast("long").alias("hits")))


def coverage_py(reports: DataFrame) -> DataFrame:
    """Executed lines count one hit, missing ones none; native expressions only."""
    shape = "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>"
    files = reports.select(F.explode(F.from_json("text", shape).files).alias("file", "f"))
    one = lambda c, h: files.select(coverage_path("file").alias("file"), F.explode(f"f.{c}").alias("line"), F.lit(h).cast("long").alias("hits"))
    return merge_lines(one("executed_lines", 1), one("missing_lines", 0))


def istanbul(reports: DataFrame) -> DataFrame:
    """The count of each statement at its first line; native expressions only."""
    shape = "map<string, struct<path: string, statementMap: map<string, struct<start: struct<line: int>>>, s: map<string, bigint>>>"
    files = reports.select(F.explode(F.from_json("text", shape)).alias("key", "f"))
    stmts = files.select(coverage_path(F.coalesce("f.path", "key")).alias("file"), F.col("f.s").alias("s"), F.explode("f.statementMap").alias("id", "at"))
    rows = stmts.select("file", F.col("at.start.line").alias("line"), F.expr("s[id]").alias("hits"))
    return merge_lines(rows.where("line IS NOT NULL AND hits IS NOT NULL"))


_XML_LINE = "array<struct<_number:int,_hits:bigint>>"
_CLASS = f"_filename string, lines struct<line:{_XML_LINE}>, methods struct<method:array<struct<lines:struct<line:{_XML_LINE}>>>>"


def cobertura(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of each class, under its name and under each source root of its report.

    A record ends with a class; what comes before the last start tag of a class in it (the head of the
    report, classes without content) has no lines, but may have the roots. A report that is no XML, or ends its
    classes in another form, is an error.
    """
    records = read_records(spark, "</class>", *paths)
    start = F.regexp_extract("record", r"(?s)^.*(<class\s.*)$", 1)
    odd = F.raise_error(F.concat(F.lit("a class of the report has no end tag that is read: "), "path"))
    start = F.when(F.col("record").rlike(r"</class\s+>"), odd).otherwise(start)
    classes = records.withColumn("start", start).where((F.col("start") != "") & ~F.col("start").rlike(r"(?s)^<class\s[^<>]*/>"))
    made = F.concat("start", F.lit("</class>"))
    c = classes.select("path", F.from_xml(made, _CLASS, {"mode": "FAILFAST"}).alias("c")).where("c._filename <> ''")
    line = F.concat(F.coalesce("c.lines.line", F.array().cast(_XML_LINE)), F.coalesce(F.flatten(F.transform("c.methods.method", lambda m: F.coalesce(m["lines"]["line"], F.array().cast(_XML_LINE)))), F.array().cast(_XML_LINE)))
    name = F.col("c._filename")
    absolute = name.rlike(r"^(/|\\|.:)")
    lines = c.select("path", name.alias("name"), absolute.alias("absolute"), F.inline(line)).select("path", "name", "absolute", F.col("_number").alias("line"), F.col("_hits").alias("hits"))
    roots = records.where(F.contains("record", F.lit("<source"))).select("path", F.explode(F.regexp_extract_all("record", F.lit(r"<source(?:\s[^>]*)?>([^<]*)</source>"), F.lit(1))).alias("root"))
    # the roots of a report, once each; entities are read as those of any text
    text = F.from_xml(F.concat(F.lit("<s><t>"), "root", F.lit("</t></s>")), "t string", {"mode": "FAILFAST"}).t
    roots = roots.select("path", F.regexp_replace(F.trim(text), "/+$", "").alias("root"), (F.trim(text) != "").alias("some")).where("some").distinct()
    own = lines.select(F.col("name").alias("file"), "line", "hits")
    below = lines.where(~F.col("absolute")).join(roots, "path").select(F.concat_ws("/", "root", "name").alias("file"), "line", "hits")
    return merge_lines(own.unionByName(below).withColumn("file", coverage_path("file")))


_LLVM = "data array<struct<files: array<struct<filename: string, segments: array<array<string>>>>, functions: array<struct<filenames: array<string>, regions: array<array<string>>>>>>"


def llvm_regions(reports: DataFrame) -> DataFrame:
    """The code regions of each function, one row each; native expressions only. A region is an array of
    numbers: start line and column, end line and column, count, file, expanded file, kind (0 is code)."""
    data = F.from_json("text", _LLVM).data
    functions = reports.select(F.posexplode(F.flatten(F.transform(data, lambda d: d["functions"]))).alias("region", "f"))
    r = functions.select("region", "f.filenames", F.explode("f.regions").alias("r")).where(F.col("r")[7] == "0")
    n = [F.col("r")[i].cast("int").alias(c) for i, c in enumerate(("start_line", "start_column", "end_line", "end_column"))]
    rows = r.select(F.expr("filenames[int(r[5])]").alias("file"), "region", *n, F.col("r")[4].cast("long").alias("hits"))
    return rows.withColumn("file", coverage_path("file"))


def llvm_stretches(reports: DataFrame) -> DataFrame:
    """(file, start_line, end_line, hits): stretches of lines with the most hits of the code regions open
    there. Rows grow with regions, not with lines."""
    return greatest_stretches(llvm_regions(reports).select("file", "start_line", "end_line", "hits"), ["file"])


def llvm(reports: DataFrame) -> DataFrame:
    """Counted segments and the lines of code regions. A segment is an array: line, column, count, whether
    it is counted, and more. Regions are merged before they become lines, so each line is made once."""
    files = reports.select(F.explode(F.from_json("text", _LLVM).data).alias("d")).select(F.explode("d.files").alias("f"))
    s = files.select("f.filename", F.explode("f.segments").alias("s")).where(F.col("s")[3] == "true")
    lines = s.select(coverage_path("filename").alias("file"), F.col("s")[0].cast("int").alias("line"), F.col("s")[2].cast("long").alias("hits"))
    open_ = llvm_stretches(reports).select("file", F.explode(F.sequence(F.col("start_line").cast("int"), F.col("end_line").cast("int"))).alias("line"), "hits")
    return merge_lines(lines, open_)


RECORDS = {"lcov": lcov, "cobertura": cobertura}
TEXTS = {"coverage-py": coverage_py, "istanbul": istanbul, "llvm": llvm}


def detect_format(path: str, head: str, shape: str | None = None) -> str:
    """By extension, then by what the text starts with, then by the shape of its JSON."""
    low = path.lower()
    if low.endswith((".info", ".lcov")) or head.startswith(("TN:", "SF:")):
        return "lcov"
    if low.endswith(".xml") or head.lstrip().startswith("<"):
        return "cobertura"
    if shape:
        return shape
    raise ValueError(f"no known coverage format: {path}")


def json_shape(text: str = "text"):
    """The format of a JSON report by its members; null where it has none of these shapes."""
    inside = lambda at: F.coalesce(F.get_json_object(text, at), F.lit(""))
    files = F.map_values(F.from_json(text, "map<string, struct<statementMap: string>>"))
    whole = (F.size(files) > 0) & F.forall(files, lambda v: v["statementMap"].isNotNull())
    return F.when(F.startswith(inside("$.files"), F.lit("{")), "coverage-py").when(F.startswith(inside("$.data"), F.lit("[")), "llvm").when(whole, "istanbul")


REPORT_NAMES = ("lcov.info", "coverage.info", "coverage.xml", "cobertura.xml", "coverage.json", "coverage-final.json", "llvm-cov.json")


def discover_report(root: str) -> str | None:
    """The shallowest report below ``root``, then the first by name."""
    found = [os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f in REPORT_NAMES]
    return min(found, key=lambda p: (p.count(os.sep), p), default=None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a report of any known format; only its first characters and its shape reach the driver."""
    known = path.lower().endswith((".info", ".lcov", ".xml"))
    texts = read_texts(spark, path)
    one = None if known else texts.select(F.substring("text", 1, 4096).alias("head"), json_shape().alias("shape")).first()
    found = detect_format(path, one.head if one else "", one.shape if one else None)
    return RECORDS[found](spark, path) if found in RECORDS else TEXTS[found](texts)
