"""Mutation reports of other tools as mutant rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import imported_status, mutation_operator, path_is_relative, repository_path
from assayer.operators.graph import settle

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def external_number(provider: str, file: str, external_id: str) -> int:
    """64-bit FNV-1a of the three names, a zero byte between them."""
    h = FNV_OFFSET
    for b in b"\0".join(x.encode() for x in (provider, file, external_id)):
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def reserve_numbers(rows: list[tuple[str, str, str]]) -> list[int]:
    """Numbers in order; one that is taken goes to the next free."""
    used: set[int] = set()
    out = []
    for r in rows:
        n = external_number(*r)
        while n in used:
            n = (n + 1) & (1 << 64) - 1
        used.add(n)
        out.append(n)
    return out


def _out(rows: DataFrame, dialect: str, status: Column) -> DataFrame:
    return rows.withColumn("status", imported_status(F.lit(dialect), status)).withColumn("operator", mutation_operator("original"))


def mutation_elements(reports: DataFrame) -> DataFrame:
    """MTE v2: files -> mutants."""
    shape = "schemaVersion string, files map<string, struct<language: string, source: string, mutants: array<struct<id: string, mutatorName: string, replacement: string, status: string, duration: double, location: struct<start: struct<line: int, column: int>, end: struct<line: int, column: int>>>>>>"
    files = reports.select(F.explode(F.from_json("text", shape).files).alias("file", "f"))
    m = files.select("file", F.col("f.source").alias("source"), F.explode("f.mutants").alias("m"))
    line = F.split("source", "\n")[F.col("m.location.start.line") - 1]
    same = F.col("m.location.start.line") == F.col("m.location.end.line")
    original = F.when(same, F.substring(line, F.col("m.location.start.column"), F.col("m.location.end.column") - F.col("m.location.start.column")))
    rows = m.select("file", F.col("m.id").alias("external_id"), F.col("m.location.start.line").alias("line"), F.col("m.location.start.column").alias("column"), F.coalesce(original, F.lit("")).alias("original"), F.coalesce("m.replacement", F.lit("")).alias("replacement"), F.col("m.duration").alias("duration"), F.col("m.status").alias("word"))
    return _out(rows, "mte", F.col("word")).drop("word")


def cargo_mutants(reports: DataFrame) -> DataFrame:
    """Outcomes of mutants; the baseline scenario is not a mutant."""
    shape = "outcomes array<struct<scenario: string, summary: string, phase_results: array<struct<duration: double>>>>"
    o = reports.select(F.explode(F.from_json("text", shape).outcomes).alias("o"))
    mutant = "Mutant struct<name: string, file: string, replacement: string, span: struct<start: struct<line: int, column: int>>>"
    m = o.select(F.from_json("o.scenario", mutant).Mutant.alias("m"), F.col("o.summary").alias("word"), F.aggregate(F.coalesce("o.phase_results", F.array().cast("array<struct<duration:double>>")), F.lit(0.0), lambda a, p: a + F.coalesce(p["duration"], F.lit(0.0))).alias("duration")).where("m.name IS NOT NULL")
    rows = m.select(F.col("m.file").alias("file"), F.col("m.name").alias("external_id"), F.col("m.span.start.line").alias("line"), F.col("m.span.start.column").alias("column"), F.regexp_extract("m.name", r"replace (\S+) with", 1).alias("original"), F.col("m.replacement").alias("replacement"), "duration", "word")
    return _out(rows, "cargo-mutants", F.col("word")).drop("word")


def muter(reports: DataFrame) -> DataFrame:
    shape = "fileReports array<struct<fileName: string, path: string, appliedOperators: array<struct<testSuiteOutcome: string, mutationPoint: struct<mutationOperatorId: string, filePath: string, position: struct<line: int, column: int>>, mutationSnapshot: struct<before: string, after: string>>>>>"
    f = reports.select(F.explode(F.from_json("text", shape).fileReports).alias("f")).select(F.explode("f.appliedOperators").alias("a"))
    p = "a.mutationPoint."
    rows = f.select(F.col(p + "filePath").alias("file"), F.concat_ws(":", p + "mutationOperatorId", p + "position.line", p + "position.column").alias("external_id"), F.col(p + "position.line").alias("line"), F.col(p + "position.column").alias("column"), F.col("a.mutationSnapshot.before").alias("original"), F.col("a.mutationSnapshot.after").alias("replacement"), F.lit(None).cast("double").alias("duration"), F.col("a.testSuiteOutcome").alias("word"))
    return _out(rows, "muter", F.col("word")).drop("word")


IMPORTERS = {"mutation-elements": mutation_elements, "cargo-mutants": cargo_mutants, "muter": muter}


MAX_IMPORTED = 100_000


def checked(rows: DataFrame, maximum: int = MAX_IMPORTED) -> DataFrame:
    """Imported rows; more than ``maximum`` of them, a path that leaves the project, a mutant without a
    place or a second one of its id in a file is an error."""
    rows = settle(rows)  # reports are parsed once: two figures and the rows are taken from them
    n = rows.agg(F.count("*").alias("n")).scalar()
    # ids are counted by themselves, and one that is told twice is enough: the rows are not exchanged
    again = rows.groupBy("file", "external_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.min(F.struct("file", "external_id")).alias("again")).scalar()
    told = rows.withColumn("_again", F.struct("file", "external_id").eqNullSafe(again))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"imported mutant {why}: "), F.coalesce("file", F.lit("?")), F.lit(" "), F.coalesce("external_id", F.lit("?"))))
    file = (
        F.when(n > maximum, fail(f"beyond {maximum}")).when(F.col("file").isNull() | ~path_is_relative("file"), fail("outside the project"))
        .when((F.coalesce("line", F.lit(0)) < 1) | (F.coalesce("column", F.lit(0)) < 1), fail("without a place")).when(F.col("_again"), fail("told twice")).otherwise(repository_path("file"))
    )
    return told.withColumn("file", file).drop("_again")


def sort_imported(rows: DataFrame) -> DataFrame:
    return rows.orderBy("file", "line", "column", "external_id")
