"""Facts of Python sources: functions, tokens, mutants, references, parse issues.

Parsing is the one step that no DataFrame expression can do; it runs once for each file, in
``mapInPandas``, and yields the fact tables. Other languages have ``lexer_facts`` with
``structural_metrics_reliable`` false, so that rules report omissions for them instead of numbers.
"""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import mutation_operator, mutation_replacement

FUNCTIONS = (
    "file string, function_id string, name string, stable_symbol string, start_line int, end_line int, complexity int, nesting_depth int, statement_count int, parameter_count int, "
    "normalized_tokens array<string>, references array<string>, excluded array<struct<s:int,e:int>>, visibility string, structural_metrics_reliable boolean, production boolean, entry_point boolean"
)
_DECISIONS = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.comprehension)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_TERMINAL = (ast.Return, ast.Raise, ast.Break, ast.Continue)


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function without those of functions, classes and lambdas inside it."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (*_FUNCTION, ast.Lambda, ast.ClassDef)):
            continue
        yield child
        yield from _own(child)


def complexity(node: ast.AST) -> int:
    n = 1
    for x in _own(node):
        n += isinstance(x, _DECISIONS)
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        n += len(x.ifs) if isinstance(x, ast.comprehension) else 0
        n += len(x.cases) - 1 if isinstance(x, ast.Match) else 0
    return n


def nesting_depth(node: ast.AST, depth: int = 0) -> int:
    best = depth
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (*_FUNCTION, ast.Lambda, ast.ClassDef)):
            best = max(best, nesting_depth(child, depth + isinstance(child, _NESTING)))
    return best


def local_names(node) -> set[str]:
    a = node.args
    names = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
    for x in _own(node):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
            names.add(x.id)
        elif isinstance(x, ast.alias):
            names.add((x.asname or x.name).split(".")[0])
        elif isinstance(x, ast.ExceptHandler) and x.name:
            names.add(x.name)
    return names


def references(node, local: set[str]) -> list[str]:
    out = set()
    for x in _own(node):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and x.id not in local:
            out.add(x.id)
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute):
            out.add("method::" + x.func.attr)
        elif isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self":
            out.add("field::" + x.attr)
    return sorted(out)


def normalized_tokens(source: str, local: set[str] = frozenset()) -> list[tuple[str, int]]:
    """(value, line): literals as LITERAL, local names as LOCAL, no comments or layout."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type in (tokenize.STRING, tokenize.NUMBER) or t.type == tokenize.NAME and t.string in ("True", "False", "None"):
                out.append(("LITERAL", t.start[0]))
            elif t.type == tokenize.NAME:
                out.append(("LOCAL" if t.string in local and not keyword.iskeyword(t.string) else t.string, t.start[0]))
            elif t.type == tokenize.OP:
                out.append((t.string, t.start[0]))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def functions_of(file: str, source: str, test: bool) -> list[tuple]:
    tree = ast.parse(source)
    lines = source.splitlines()
    out: list[tuple] = []

    def visit(node: ast.AST, owner: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _FUNCTION):
                local = local_names(child)
                text = "\n".join(line[child.col_offset :] if line.strip() else "" for line in lines[child.lineno - 1 : child.end_lineno])
                tokens = [v for v, _ in normalized_tokens(text, local)]
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)] + [x.arg for x in (a.vararg, a.kwarg) if x]
                inner = [x for x in ast.walk(child) if x is not child and isinstance(x, (*_FUNCTION, ast.Lambda, ast.ClassDef))]
                symbol = ".".join([*owner, child.name]) + f"({len(params)})"
                out.append((
                    file, child.name, symbol, child.lineno, child.end_lineno, complexity(child), nesting_depth(child), sum(isinstance(x, ast.stmt) for x in _own(child)), len(params),
                    tokens, references(child, local), [{"s": x.lineno, "e": x.end_lineno} for x in inner if not isinstance(x, ast.Lambda)],
                    "private" if child.name.startswith("_") and not child.name.startswith("__") else "public", True, not test, child.name == "main" or bool(child.decorator_list),
                ))
            elif isinstance(child, ast.ClassDef):
                visit(child, [*owner, child.name])
            elif not isinstance(child, ast.Lambda):
                visit(child, owner)

    visit(tree, [])
    return out


def disambiguate(rows: list[tuple]) -> list[tuple]:
    """Equal symbols of a file get ``#`` and twelve digits of their tokens' digest, then an ordinal."""
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r[2], []).append(i)
    out = list(rows)
    for symbol, at in by.items():
        seen: dict[str, int] = {}
        for i in at if len(at) > 1 else ():
            d = hashlib.sha256("\0".join(rows[i][9]).encode()).hexdigest()[:12]
            seen[d] = seen.get(d, 0) + 1
            out[i] = (*rows[i][:2], f"{symbol}#{d}" + (f":{seen[d]}" if seen[d] > 1 else ""), *rows[i][3:])
    return out


def python_functions(files: DataFrame) -> DataFrame:
    """``files``: relative, text, test. Files that do not parse give no functions; see ``parse_issues``."""
    names = [c.split()[0] for c in re.split(r", (?![es]:)", FUNCTIONS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text, test in zip(b.relative, b.text, b.test, strict=True):
                try:
                    rows += disambiguate(functions_of(file, text or "", bool(test)))
                except (SyntaxError, ValueError):
                    pass
            yield pd.DataFrame([(r[0], f"{r[0]}::{r[2]}", *r[1:]) for r in rows], columns=names)

    return files.select("relative", "text", "test").mapInPandas(run, FUNCTIONS)


def parse_issues(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b.relative, b.text, strict=True):
                try:
                    ast.parse(text or "")
                except (SyntaxError, ValueError) as e:
                    rows.append((file, int(getattr(e, "lineno", 0) or 0), str(e)))
            yield pd.DataFrame(rows, columns=["file", "line", "message"])

    return files.select("relative", "text").mapInPandas(run, "file string, line int, message string")


def tokens(files: DataFrame) -> DataFrame:
    """(file, index, line, value) of whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, i, ln, v) for f, t in zip(b.relative, b.text, strict=True) for i, (v, ln) in enumerate(normalized_tokens(t or ""))], columns=["file", "index", "line", "value"])

    return files.select("relative", "text").mapInPandas(run, "file string, index long, line int, value string")


_LEXEMES = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|#[^\n]*)|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<num>\d[\w.]*)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|&&|\|\||->|::|[^\w\s])", re.S)


def lexer_tokens(text: str) -> list[tuple[str, int]]:
    """Tokens of a C-like or shell source, by lexical form alone."""
    out, line = [], 1
    for m in _LEXEMES.finditer(text):
        kind = m.lastgroup
        if kind in ("str", "num"):
            out.append(("LITERAL", line))
        elif kind != "skip":
            out.append((m[0], line))
        line += m[0].count("\n")
    return out


def lexer_facts(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, i, ln, v) for f, t in zip(b.relative, b.text, strict=True) for i, (v, ln) in enumerate(lexer_tokens(t or ""))], columns=["file", "index", "line", "value"])

    return files.select("relative", "text").mapInPandas(run, "file string, index long, line int, value string")


def _span_mutants(file: str, source: str) -> list[tuple]:
    """Operators with operands on both sides, and boolean literals, in source order without overlap."""
    tree = ast.parse(source)
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    raw = source.encode()
    symbols = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.And: "and", ast.Or: "or", ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
    found = []

    def between(left: ast.AST, right: ast.AST, op: ast.AST) -> None:
        s = symbols.get(type(op))
        if s is None:
            return
        lo, hi = starts[left.end_lineno - 1] + left.end_col_offset, starts[right.lineno - 1] + right.col_offset
        at = raw.find(s.encode(), lo, hi)
        if at >= 0:
            line = raw.count(b"\n", 0, at) + 1
            found.append((file, line, at - starts[line - 1] + 1, at, at + len(s), s))

    for x in ast.walk(tree):
        if isinstance(x, ast.BinOp):
            between(x.left, x.right, x.op)
        elif isinstance(x, ast.BoolOp):
            for a, b in zip(x.values, x.values[1:], strict=False):
                between(a, b, x.op)
        elif isinstance(x, ast.Compare):
            for a, op, b in zip([x.left, *x.comparators], x.ops, x.comparators, strict=False):
                between(a, b, op)
        elif isinstance(x, ast.Constant) and isinstance(x.value, bool):
            at = starts[x.lineno - 1] + x.col_offset
            found.append((file, x.lineno, x.col_offset + 1, at, at + len(str(x.value)), str(x.value)))
    out, end = [], -1
    for r in sorted(found, key=lambda r: (r[3], r[4])):
        if r[3] >= end:
            out.append(r)
            end = r[4]
    return out


def python_mutants(files: DataFrame) -> DataFrame:
    """Candidates: file, line, column, start_byte, end_byte, original, replacement, operator; empty symbol and fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b.relative, b.text, strict=True):
                try:
                    rows += _span_mutants(file, text or "")
                except (SyntaxError, ValueError):
                    pass
            yield pd.DataFrame(rows, columns=["file", "line", "column", "start_byte", "end_byte", "original"])

    out = files.select("relative", "text").mapInPandas(run, "file string, line int, column int, start_byte long, end_byte long, original string")
    out = out.withColumn("replacement", mutation_replacement(F.lit("python"), "original")).where("replacement IS NOT NULL")
    return out.withColumns({"operator": mutation_operator("original"), "stable_symbol": F.lit(""), "fingerprint": F.lit("")})


def identifier_counts(token_rows: DataFrame, package_of: DataFrame) -> DataFrame:
    """(package, identifier, production_references, test_references). ``package_of``: file, package, test."""
    names = token_rows.where(F.col("value").rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.col("value").isin("LITERAL", "LOCAL", *keyword.kwlist))
    j = names.join(package_of, "file")
    return j.groupBy("package", F.col("value").alias("identifier")).agg(F.count_if(~F.col("test")).alias("production_references"), F.count_if("test").alias("test_references"))


def unreachable_statements(files: DataFrame) -> DataFrame:
    """(file, line) of statements after an unconditional return, raise, break or continue of their block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b.relative, b.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for x in ast.walk(tree):
                    for block in (getattr(x, n, None) for n in ("body", "orelse", "finalbody")):
                        if isinstance(block, list):
                            ends = next((i for i, s in enumerate(block) if isinstance(s, _TERMINAL)), None)
                            rows += [(file, s.lineno) for s in block[ends + 1 :]] if ends is not None else []
            yield pd.DataFrame(rows, columns=["file", "line"])

    return files.select("relative", "text").mapInPandas(run, "file string, line int")
