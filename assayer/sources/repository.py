"""Source files, configuration and project metadata."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shlex
import shutil
import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.columns import coverage_path, is_excluded_path, is_generated_path, is_test_path, language_of, shebang_language
from assayer.operators.graph import forget, settle

PROJECT_MARKERS = {
    "cargo": ("Cargo.toml",), "compilation-database": ("compile_commands.json", "build/compile_commands.json"), "typescript": ("tsconfig.json", "package.json"),
    "swift-package": ("Package.swift",), "python": ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt"),
}
#: Mutation tools by the file that shows a project they apply to and the program they need.
MUTATION_TOOLS = {"built-in": (None, None), "cargo-mutants": ("cargo", "cargo-mutants"), "mutmut": ("python", "mutmut"), "stryker": ("typescript", "stryker"), "muter": ("swift-package", "muter"), "mull": ("compilation-database", "mull-runner")}
SECTIONS = ("analysis", "crap", "dry", "mutation", "kiss", "yagni", "architecture", "cohesion", "baseline")
DEFAULT_CONFIG = {
    "crap": {"fail_over": 6.0}, "dry": {"min_tokens": 30, "min_statements": 5, "similarity_threshold": 0.92, "shingle_tokens": 4, "max_groups": 50, "max_occurrences_per_window": 100},
    "mutation": {"minimum_score": 0.8, "seed": 76412026}, "kiss": {"maximum_cyclomatic_complexity": 12, "maximum_nesting_depth": 5, "maximum_function_statements": 60, "maximum_parameters": 6, "maximum_module_dependencies": 16},
    "yagni": {}, "architecture": {"maximum_module_fan_out": 12}, "cohesion": {"minimum": 0.1}, "baseline": {"enabled": False}, "analysis": {},
}


#: Settings that are shares, and settings that may be nought; all other numbers are counts of one or more.
SHARES = {"similarity_threshold", "minimum_score", "minimum"}
FROM_ZERO = {"fail_over", "seed"}
#: Further settings that a section may have.
MORE_KEYS = {
    "analysis": ("languages", "filters", "include_tests", "max_source_bytes"), "mutation": ("provider", "operators", "max_mutants", "timeout_seconds"), "baseline": ("path",),
    "yagni": ("maximum_unused_private_functions", "maximum_unreferenced_exports", "maximum_unused_dependencies", "maximum_unused_modules", "maximum_unreachable", "maximum_unused_features", "entry_points"),
    "architecture": ("layers", "forbidden", "domain", "infrastructure", "interfaces", "implementations", "contract_traits", "contract_marker"),
}


def load_config(text: str) -> dict:
    """Defaults with what the TOML text sets. An unknown section or setting is an error, and so is a
    number out of its range."""
    given = tomllib.loads(text)
    if unknown := set(given) - set(SECTIONS):
        raise ValueError(f"unknown configuration sections: {sorted(unknown)}")
    for section, values in given.items():
        if not isinstance(values, dict):
            raise ValueError(f"{section} is not a section")
        known = {*DEFAULT_CONFIG.get(section, {}), *MORE_KEYS.get(section, ())}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings in {section}: {sorted(unknown)}")
        for k, v in values.items():
            if isinstance(v, bool) or not isinstance(v, int | float):
                continue
            low, high = (0, 1) if k in SHARES else (0, float("inf")) if k in FROM_ZERO or section == "yagni" else (1, float("inf"))
            if not low <= v <= high:
                raise ValueError(f"{section}.{k} is out of range: {v}")
    return {s: DEFAULT_CONFIG.get(s, {}) | given.get(s, {}) for s in SECTIONS}


def find_config(start: str, name: str = "assayer.toml") -> str | None:
    """The configuration file of ``start`` or of the nearest folder above that has one."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            return path
        if folder == os.path.dirname(folder):
            return None
        folder = os.path.dirname(folder)


def project_kinds(root: str) -> set[str]:
    found = {k for k, names in PROJECT_MARKERS.items() if any(os.path.isfile(os.path.join(root, n)) for n in names)}
    return found or {"generic"}


def mutation_tools(root: str) -> list[dict]:
    """Static inventory: which tools apply to the project and whether their program is on the path."""
    kinds = project_kinds(root)
    return [{"id": k, "applicable": kind is None or kind in kinds, "available": program is None or shutil.which(program) is not None} for k, (kind, program) in MUTATION_TOOLS.items()]


def scope_fingerprint(request: dict, config: dict, check: dict) -> str:
    """Identity of an analysis: settings in canonical JSON, without the baseline section, lists sorted."""
    scope = {"version": 1, "request": request | {"filters": sorted(set(request.get("filters", ())))}, "config": {k: v for k, v in config.items() if k != "baseline"}, "check": check}
    evidence = json.dumps(scope, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    h = hashlib.sha256()
    for part in ("check.analysis-scope", "Cargo.toml", "check", evidence):
        h.update(len(part.encode()).to_bytes(8, "big") + part.encode())
    return h.hexdigest()


def _glob(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over a whole path: ``*`` and ``?`` stay within
    a folder, ``**`` does not, a set in brackets is one character, a backslash takes the next as it is."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i) and i + 2 == len(pattern) and i and pattern[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = re.sub(r"([\\\\\[&])", r"\\\1", pattern[i + 1 : end])
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
        else:
            i += c == "\\" and i + 1 < len(pattern)
            out.append(re.escape(pattern[i]))
            i += 1
    return "".join(out)


def parse_ignore_file(text: str) -> list[tuple[str, bool, bool]]:
    """(expression, folders only, negated) of the lines of an ignore file, in its order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out.append((("" if anchored else "(?:.*/)?") + _glob(line.lstrip("/")), folders, negated))
    return out


IGNORE_FILES = (".gitignore", ".ignore")
_RULES = "base string, file string, line int, expression string, folders boolean, negated boolean"


def ignore_rules(files: DataFrame) -> DataFrame:
    """``files`` (relative, text of ignore files) -> their rules: base (the folder they hold for), file,
    line, expression (over a path below the base), folders, negated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, _, name = path.rpartition("/")
                rows += [(base, name, i, *rule) for i, rule in enumerate(parse_ignore_file(text or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _RULES.split(", ")])

    return files.select("relative", "text").mapInArrow(run, _RULES)


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(relative) of the ``entries`` (relative, folder) that the rules leave out by themselves.

    An entry meets the rules of the folders above it by equality. The last rule that matches decides: the
    deepest base, in a folder ``.ignore`` over ``.gitignore``, in a file the last line. What lies in a folder
    that is left out must not be asked for: nothing comes back from it.
    """
    parts = F.split("relative", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = entries.select("relative", "folder", F.explode(above).alias("base")).join(rules, "base")
    inner = F.when(F.col("base") == "", F.col("relative")).otherwise(F.expr("substring(relative, length(base) + 2)"))
    hits = met.where((F.col("folder") | ~F.col("folders")) & F.regexp_like(inner, F.concat(F.lit("(?s)^(?:"), "expression", F.lit(")$"))))
    order = F.struct(F.length("base"), (F.col("file") == ".ignore"), "line")
    return hits.groupBy("relative").agg(F.max_by("negated", order).alias("negated")).where("NOT negated").select("relative")


_ENTRIES = "relative string, folder boolean, length long"


def _scan(root: str):
    """Entries of folders, by the workers: Spark's own listing leaves out every name that starts with a dot
    or an underscore, and with them ignore files and ``__init__.py``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        here = f"{folder}/{e.name}" if folder else e.name
                        if e.is_dir(follow_symlinks=False):
                            rows.append((here, True, 0))
                        elif e.is_file(follow_symlinks=False):
                            rows.append((here, False, e.stat(follow_symlinks=False).st_size))
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["relative", "folder", "length"])

    return run


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` (relative and more) with text: only these files are opened."""
    schema = T.StructType([*files.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column("relative").to_pylist()):
                with open(os.path.join(root, path), "rb") as f:
                    text = f.read().decode("utf-8", "replace")
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([text], pa.string())], names=schema.names)

    return files.mapInArrow(run, schema)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative, length) of the files below ``root`` that no excluded folder and no ignore file leaves out.

    Folders are listed level by level, by tasks; a folder that is excluded or ignored is never opened, and of
    files only ignore files are read. Links are not followed. The workers must see the folder.
    """
    root = re.sub("^file:/+", "/", root).rstrip("/") or "/"
    folders, found, rules = spark.createDataFrame([("",)], "relative string"), [], spark.createDataFrame([], _RULES)
    while True:
        entries = folders.repartition(spark.sparkContext.defaultParallelism, "relative").mapInArrow(_scan(root), _ENTRIES)
        entries = settle(entries.where(~is_excluded_path("relative")))
        own = entries.where(~F.col("folder") & F.substring_index("relative", "/", -1).isin(*IGNORE_FILES))
        rules = rules.unionByName(settle(ignore_rules(read_files(own.select("relative"), root))))
        left = settle(entries.join(ignored(entries, rules), "relative", "left_anti"))
        forget(entries)
        found.append(left.where(~F.col("folder")).select("relative", "length"))
        folders = left.where("folder").select("relative")
        if folders.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)


def source_files(spark: SparkSession, root: str, languages: tuple[str, ...] = (), filters: tuple[str, ...] = (), include_tests: bool = False, max_bytes: int = 8 << 20) -> DataFrame:
    """(relative, language, generated, test, text) of the selected sources below ``root``.

    Only files that may be selected are opened: those of a known extension, and of those without one the
    first bytes, for a line that names a shell. A selected source of more than ``max_bytes`` is an error that names it:
    a run over a part of the sources would look like a run over all.
    """
    root = re.sub("^file:/+", "/", root).rstrip("/") or "/"
    rows = listing(spark, root).withColumn("language", language_of("relative", languages))
    bare = rows.where(F.col("language").isNull() & ~F.contains(F.substring_index("relative", "/", -1), F.lit(".")))
    shells = _heads(bare.select("relative", "length"), root).withColumn("language", shebang_language("head")).where("language IS NOT NULL").select("relative", "length", "language")
    rows = rows.where("language IS NOT NULL").unionByName(shells)
    rows = rows.withColumn("generated", is_generated_path("relative")).withColumn("test", is_test_path("relative", "language"))
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    if filters:
        rows = rows.where(reduce(lambda a, b: a | b, (F.contains("relative", F.lit(f)) for f in filters)))
    if not include_tests:
        rows = rows.where(~F.col("test"))
    large = F.raise_error(F.concat(F.lit(f"source of more than {max_bytes} bytes: "), "relative")).cast("string")
    rows = rows.withColumn("relative", F.when(F.col("length") > max_bytes, large).otherwise(F.col("relative")))
    return read_files(rows, root).drop("length")


def _heads(files: DataFrame, root: str, octets: int = 4096) -> DataFrame:
    """``files`` with head: their first bytes as text."""
    schema = T.StructType([*files.schema.fields, T.StructField("head", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = []
            for path in b.column("relative").to_pylist():
                with open(os.path.join(root, path), "rb") as f:
                    heads.append(f.read(octets).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.string())], names=schema.names)

    return files.mapInArrow(run, schema)


def compile_commands(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """(directory, file, arguments, output, index) of a compilation database, in its order.

    Folders are resolved against the database's own (``base``), files against their folder. An entry has
    arguments or a command, which is split as a shell does; both, neither, an empty one, or an empty
    folder or file is an error. A file may have several commands; all are kept.
    """
    shape = "array<struct<directory: string, file: string, arguments: array<string>, command: string, output: string>>"
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    e = text.select("path", F.posexplode(F.from_json("text", shape)).alias("index", "e")).select("path", "index", "e.*")
    own = F.lit(base) if base else F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/[^/]*$", "")
    bad = lambda why: F.raise_error(F.concat(F.lit("compilation database entry "), F.col("index").cast("string"), F.lit(f": {why}")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    @F.pandas_udf("array<string>")
    def split(commands: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else shlex.split(c) for c in commands])

    given, made = F.col("arguments"), split("command")
    arguments = F.when(empty("directory") | empty("file"), bad("directory and file must be set")).when(given.isNotNull() & F.col("command").isNotNull(), bad("arguments and command")).when(F.size(F.coalesce(given, made)) > 0, F.coalesce(given, made)).otherwise(bad("neither arguments nor command"))
    absolute = lambda c: c.rlike(r"^(/|[A-Za-z]:[/\\\\])")
    folder = coverage_path(F.when(absolute(F.col("directory")), F.col("directory")).otherwise(F.concat_ws("/", own, "directory")))
    rows = e.withColumn("arguments", arguments).withColumn("directory", folder)
    return rows.select("directory", coverage_path(F.when(absolute(F.col("file")), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))).alias("file"), "arguments", "output", "index")


def cargo_metadata(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packages, dependencies, features) of workspace metadata documents."""
    shape = "workspace_root string, workspace_members array<string>, packages array<struct<id: string, name: string, manifest_path: string, dependencies: array<struct<name: string, kind: string, rename: string, optional: boolean, target: string>>, features: map<string, array<string>>>>"
    m = texts.select(F.from_json("text", shape).alias("m"))
    p = m.select(F.col("m.workspace_root").alias("root_dir"), F.col("m.workspace_members").alias("members"), F.explode("m.packages").alias("p")).where(F.expr("array_contains(members, p.id)"))
    packages = p.select(F.col("p.name").alias("name"), F.regexp_replace(F.expr("replace(p.manifest_path, concat(root_dir, '/'), '')"), "/?Cargo.toml$", "").alias("root"))
    d = p.select(F.col("p.name").alias("package"), F.explode("p.dependencies").alias("d"))
    names = packages.select(F.col("name").alias("dependency"), F.lit(True).alias("known")).distinct()
    deps = d.select("package", F.col("d.name").alias("dependency"), F.coalesce("d.rename", "d.name").alias("source_identifier"), F.when(F.col("d.kind") == "dev", "development").when(F.col("d.kind") == "build", "build").otherwise("production").alias("scope"), F.coalesce("d.optional", F.lit(False)).alias("optional"), F.col("d.target").isNotNull().alias("target_gated"))
    deps = deps.join(names, "dependency", "left").withColumn("internal", F.coalesce("known", F.lit(False))).drop("known")
    features = p.select(F.col("p.name").alias("package"), F.explode("p.features").alias("name", "enables")).select("package", "name", F.lit(0).alias("references"), "enables", F.lit(False).alias("target_gated"))
    return packages, deps, features


def baseline_rules(spark: SparkSession, path: str, expected_scope: str) -> DataFrame:
    """Rule rows of a prior native report; another analysis scope is an error."""
    text = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("t")).first().t
    report = json.loads(text)
    if report.get("analysis_scope") != expected_scope:
        raise ValueError("the baseline has another analysis scope")
    rows = [(r["rule_id"], r["violation_id"], r["file"], r["stable_symbol"], r["result"], float(r["excess"])) for r in report["rules"]]
    return spark.createDataFrame(rows, "rule_id string, violation_id string, file string, stable_symbol string, result string, excess double")
