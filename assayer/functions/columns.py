"""Scalar functions over fact columns, as native Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
EXCLUDED_DIRECTORIES = (".git", ".hg", ".idea", ".pytest_cache", ".tox", ".venv", ".build", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv", "DerivedData", "Pods")
GENERATED_DIRECTORIES = ("generated", "gen", "DerivedSources")
EXTENSIONS = {
    "bash": ("sh", "bash", "bats"), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"), "objective-c": ("m", "mm", "h"),
    "python": ("py",), "rust": ("rs",), "swift": ("swift",), "typescript": ("ts", "tsx", "mts", "cts"),
}
C_FAMILY = ("c", "cpp", "objective-c")
TEST_SUFFIXES = {
    "bash": (".bats",), "c": ("_test.c", "_tests.c"), "cpp": ("_test.cpp", "_tests.cpp", "_test.cc", "_tests.cc"), "objective-c": ("tests.m", "tests.mm", "test.m", "test.mm"),
    "python": ("_test.py",), "rust": ("_test.rs",), "swift": ("tests.swift", "test.swift"), "typescript": (".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx"),
}
REPLACEMENTS = {
    "common": (("==", "!="), ("!=", "=="), (">", "<="), ("<", ">="), (">=", "<"), ("<=", ">"), ("&&", "||"), ("||", "&&"), ("true", "false"), ("false", "true"), ("+", "-"), ("-", "+"), ("*", "/"), ("/", "*")),
    "bash": (("-eq", "-ne"), ("-ne", "-eq"), ("-gt", "-le"), ("-ge", "-lt"), ("-lt", "-ge"), ("-le", "-gt")),
    "objective-c": (("YES", "NO"), ("NO", "YES")),
    "python": (("True", "False"), ("False", "True"), ("and", "or"), ("or", "and")),
}
OPERATOR_FAMILIES = {
    "boolean-literal": ("true", "false", "True", "False", "YES", "NO"),
    "comparison": ("==", "!=", "<", "<=", ">", ">=", "-eq", "-ne", "-gt", "-ge", "-lt", "-le"),
    "logical": ("&&", "||", "and", "or"),
    "arithmetic": ("+", "-", "*", "/", "%"),
}
MUTATOR_CLASSES = {
    "EqualityOperator": ("==", "!="),
    "RelationalOperator": (">", ">=", "<", "<="),
    "LogicalOperator": ("&&", "||", "and", "or"),
    "ArithmeticOperator": ("+", "-", "*", "/"),
}
BOOLEAN_LITERALS = ("true", "false", "True", "False", "YES", "NO")
UBIQUITOUS = ("self", "Self", "Result", "Option", "Some", "None", "Ok", "Err", "new", "default")
IMPORTED_STATUSES = (
    ("mte", "Killed", "killed"), ("mte", "Survived", "survived"), ("mte", "NoCoverage", "no-coverage"), ("mte", "CompileError", "compile-error"),
    ("mte", "RuntimeError", "runtime-error"), ("mte", "Timeout", "timeout"), ("mte", "Ignored", "ignored"), ("mte", "Pending", "pending"),
    ("cargo-mutants", "CaughtMutant", "killed"), ("cargo-mutants", "MissedMutant", "survived"), ("cargo-mutants", "Success", "survived"), ("cargo-mutants", "Unviable", "compile-error"),
    ("cargo-mutants", "Failure", "runtime-error"), ("cargo-mutants", "Timeout", "timeout"),
    ("muter", "failed", "killed"), ("muter", "runtimeError", "killed"), ("muter", "passed", "survived"), ("muter", "buildError", "compile-error"), ("muter", "timeout", "timeout"),
)
STATUSES = ("killed", "survived", "no-coverage", "compile-error", "runtime-error", "timeout", "ignored", "invalid", "pending")
UNRESOLVED = ("no-coverage", "compile-error", "runtime-error", "timeout", "invalid", "pending")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def length_prefixed(c) -> Column:
    """Big-endian 64-bit byte length, then the UTF-8 bytes."""
    c = _col(c)
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), F.encode(c, "UTF-8"))


def path_is_relative(path) -> Column:
    """True where ``repository_path`` has a value of its own: relative, no drive, no parent, some part."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    return (p != "") & ~F.startswith(p, F.lit("/")) & ~F.coalesce(F.substring(p, 2, 1) == ":", F.lit(False)) & (F.size(parts) > 0) & ~F.array_contains(parts, "..")


def repository_path(path) -> Column:
    """Forward slashes, no empty or ``.`` parts; null where the path is not a relative one."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return F.when(path_is_relative(path), F.array_join(F.filter(F.split(p, "/"), lambda x: ~x.isin("", ".")), "/"))


def stable_id(rule, path, symbol, evidence) -> Column:
    """SHA-256 over the length-prefixed parts; a path that is not relative only has its slashes turned."""
    path = F.coalesce(repository_path(path), F.replace(_col(path), F.lit("\\"), F.lit("/")))
    return F.sha2(F.concat(length_prefixed(rule), length_prefixed(path), length_prefixed(symbol), length_prefixed(evidence)), 256)


def short_digest(identifier) -> Column:
    return F.substring(_col(identifier), 1, 12)


def coverage_path(path) -> Column:
    """A path in a coverage report: slashes, ``.`` and ``..`` resolved; drive and UNC paths without case."""
    raw = F.regexp_replace(F.replace(F.trim(_col(path)), F.lit("\\"), F.lit("/")), "^file://", "")
    drive, unc = F.substring(raw, 2, 1) == ":", F.startswith(raw, F.lit("//"))
    prefix = F.when(drive, F.substring(raw, 1, 2)).when(unc, "//").when(F.startswith(raw, F.lit("/")), "/").otherwise("")
    rest = F.when(drive, F.substring(raw, F.lit(3), F.char_length(raw))).otherwise(raw)
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        up = F.when(can_pop, F.slice(done, 1, F.size(done) - 1)).when(prefix == "", F.concat(done, F.array(part))).otherwise(done)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    body = F.array_join(F.aggregate(F.split(rest, "/"), empty, step), "/")
    joined = F.when(drive, F.concat(prefix, F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("/"), body)))).otherwise(F.concat(prefix, body))
    joined = F.when((prefix == "") & (body == ""), ".").otherwise(joined)
    return F.when(drive | unc, F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(joined)


def crap_score(complexity, coverage) -> Column:
    c, gap = _col(complexity).cast("double"), 1 - _col(coverage) / 100
    return c * c * (gap * gap * gap) + c


def coverage_percent(covered, executable) -> Column:
    return F.when(_col(executable) > 0, 100.0 * _col(covered) / _col(executable))


def instability(afferent, efferent) -> Column:
    a, e = _col(afferent), _col(efferent)
    return F.when(a + e == 0, 0.0).otherwise(e / (a + e))


def matches_pattern(pattern, value) -> Column:
    """Equality, or one ``*`` for any text; two stars match nothing."""
    p, v = _col(pattern), _col(value)
    head, tail = F.substring_index(p, "*", 1), F.substring(p, F.instr(p, "*") + 1, F.char_length(p))
    long = F.octet_length(v) >= F.octet_length(head) + F.octet_length(tail)
    return F.when(F.instr(p, "*") == 0, p == v).otherwise(~F.contains(tail, F.lit("*")) & long & F.startswith(v, head) & F.endswith(v, tail))


def edge_pattern(pattern) -> Column:
    """(source, target) of ``source->target``; null if it is not one or a side has two stars."""
    p = _col(pattern)
    at = F.instr(p, "->")
    source, target = F.substring(p, F.lit(1), at - 1), F.substring(p, at + 2, F.char_length(p))
    stars = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("*"), F.lit("")))
    valid = (at > 0) & (source != "") & (target != "") & (stars(source) <= 1) & (stars(target) <= 1)
    return F.when(valid, F.struct(source.alias("source"), target.alias("target")))


def without_duplicate_suffix(symbol) -> Column:
    return F.regexp_replace(_col(symbol), r"(?s)^(.*\))#[0-9A-Fa-f]{12}(?::[0-9]+)?$", "$1")


def without_terminal_signature(symbol) -> Column:
    """Cut the parenthesis that closes the text, balanced from the right."""
    s = _col(symbol)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("cut"))

    def step(a: Column, c: Column) -> Column:
        depth = F.when(c == ")", a.depth + 1).when(c == "(", F.greatest(a.depth - 1, F.lit(0))).otherwise(a.depth)
        cut = F.when((a.cut == 0) & (c == "(") & (depth == 0), a.seen + 1).otherwise(a.cut)
        return F.struct(depth.alias("depth"), (a.seen + 1).alias("seen"), cut.alias("cut"))

    cut = F.aggregate(F.split(F.reverse(s), ""), start, step).cut
    return F.when(F.endswith(s, F.lit(")")) & (cut > 0), F.substring(s, F.lit(1), F.char_length(s) - cut)).otherwise(s)


def bare_symbol(symbol) -> Column:
    return without_terminal_signature(without_duplicate_suffix(symbol))


def _leaf(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(c, "::", -1), ".", -1), "^(?:r#)+", "")


def simple_name(symbol) -> Column:
    return _leaf(bare_symbol(symbol))


def reference_leaf(reference) -> Column:
    return _leaf(F.regexp_replace(_col(reference), "!+$", ""))


def reference_segments(value) -> Column:
    parts = F.split(F.regexp_replace(bare_symbol(value), "!+$", ""), "[:.]")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, "^(?:r#)+", ""))
    return F.filter(parts, lambda p: ~p.isin("", "crate", "self", "super"))


def cohesion_owner(symbol, file) -> Column:
    """The symbol without its last segment; without one, the file."""
    s = bare_symbol(symbol)
    return F.when(s.rlike(r"::|\."), F.regexp_replace(s, r"(?s)(?:::|\.)(?:(?!::)[^.])*$", "")).otherwise(_col(file))


def ubiquitous_reference(reference) -> Column:
    return F.regexp_replace(_col(reference), "^method::", "").isin(*UBIQUITOUS)


def manifest_file(root) -> Column:
    r = F.regexp_replace(_col(root), "/+$", "")
    return F.when(r.isin("", "."), "Cargo.toml").when(F.endswith(r, F.lit("Cargo.toml")), r).otherwise(F.concat(r, F.lit("/Cargo.toml")))


def encoded_components(values) -> Column:
    """``length:value`` of each element, byte lengths, joined."""
    return F.array_join(F.transform(_col(values), lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)), "")


def mutation_operator(original) -> Column:
    o = _col(original)
    return reduce(lambda acc, kv: acc.when(o.isin(*kv[1]), kv[0]), list(OPERATOR_FAMILIES.items())[1:], F.when(o.isin(*OPERATOR_FAMILIES["boolean-literal"]), "boolean-literal")).otherwise("other")


def mutator_name(original, replacement) -> Column:
    o, r = _col(original), _col(replacement)
    out = F.when(F.lit(False), "")
    for name, members in MUTATOR_CLASSES.items():
        out = out.when(o.isin(*members) & r.isin(*members), name)
    return out.when(o.isin(*BOOLEAN_LITERALS), "BooleanLiteral").otherwise("GenericMutation")


def imported_status(dialect, value) -> Column:
    """The status of a report's word; an unknown one is an error."""
    d, v = _col(dialect), _col(value)
    out = F.when(F.lit(False), "")
    for name, word, status in IMPORTED_STATUSES:
        out = out.when((d == name) & (v == word), status)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported status "), F.coalesce(v, F.lit("null")))))


def is_scoreable(status) -> Column:
    return _col(status).isin("killed", "survived")


def is_unresolved(status) -> Column:
    return _col(status).isin(*UNRESOLVED)


def seeded_key(seed, fingerprint) -> Column:
    """SHA-256 of the seed's eight bytes and the length-prefixed fingerprint; hex sorts as bytes do."""
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(_col(seed).cast("long")), 16, "0")), length_prefixed(fingerprint)), 256)


def is_excluded_path(path) -> Column:
    return F.arrays_overlap(F.split(_col(path), "/"), F.array(*map(F.lit, EXCLUDED_DIRECTORIES)))


def span_within(inner, outer) -> Column:
    i, o = _col(inner), _col(outer)
    at = lambda s, w: F.struct(s[f"{w}_line"].alias("l"), s[f"{w}_column"].alias("c"))
    return (at(o, "start") <= at(i, "start")) & (at(i, "end") <= at(o, "end"))


def spans_intersect(left, right) -> Column:
    a, b = _col(left), _col(right)
    at = lambda s, w: F.struct(s[f"{w}_line"].alias("l"), s[f"{w}_column"].alias("c"))
    return (at(a, "start") < at(b, "end")) & (at(b, "start") < at(a, "end"))


def path_uri(path) -> Column:
    """Percent-encode all bytes but unreserved ones, the colon and the slash."""
    e = F.url_encode(F.replace(_col(path), F.lit("\\"), F.lit("/")))
    e = F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    e = F.replace(e, F.lit("%3A"), F.lit(":"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def escape_terminal(text) -> Column:
    """Control and bidirectional characters as \\u{hex}."""
    def one(c: Column) -> Column:
        bad = c.rlike("[\\x00-\\x1f\\x7f-\\x9f\\u061c\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]")
        code = F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "^0+", ""))
        return F.when(bad, F.concat(F.lit("\\u{"), F.when(code == "", "0").otherwise(code), F.lit("}"))).otherwise(c)

    return F.array_join(F.transform(F.split(_col(text), ""), one), "")


def extension_of(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([^./\\\\]+)$", 1))


def language_of(path, requested: tuple[str, ...] = ()) -> Column:
    """By extension; ``.h`` belongs to the only requested C-family language, else to C."""
    e = extension_of(path)
    family = [x for x in requested if x in C_FAMILY]
    out = F.when(e == "h", family[0] if len(family) == 1 else "c")
    for language, extensions in EXTENSIONS.items():
        out = out.when(e.isin(*(x for x in extensions if x != "h")), language)
    return out


def shebang_language(head) -> Column:
    """bash where the first line of a file names a shell."""
    first = F.substring_index(_col(head), "\n", 1)
    return F.when(F.startswith(first, F.lit("#!")) & (F.contains(first, F.lit("bash")) | F.contains(first, F.lit("/sh"))), "bash")


def is_test_path(path, language) -> Column:
    p = F.lower(F.replace(_col(path), F.lit("\\"), F.lit("/")))
    name, parts, lang = F.substring_index(p, "/", -1), F.split(p, "/"), _col(language)
    out = F.array_contains(parts, "test") | F.array_contains(parts, "tests") | ((lang == "typescript") & F.array_contains(parts, "__tests__")) | ((lang == "python") & F.startswith(name, F.lit("test_")))
    for language_, suffixes in TEST_SUFFIXES.items():
        for s in suffixes:
            out = out | ((lang == language_) & F.endswith(name, F.lit(s)))
    return out


def is_generated_path(path) -> Column:
    return F.arrays_overlap(F.split(_col(path), "/"), F.array(*map(F.lit, GENERATED_DIRECTORIES)))


def mutation_replacement(language, original) -> Column:
    """The replacement of an operator or literal; the language's own table first, null without one."""
    lang, o = _col(language), _col(original)
    out = F.when(F.lit(False), "")
    for name in ("bash", "objective-c", "python"):
        for a, b in REPLACEMENTS[name]:
            out = out.when((lang == name) & (o == a), b)
    for a, b in REPLACEMENTS["common"]:
        out = out.when(o == a, b)
    return out
