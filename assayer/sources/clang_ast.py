"""Functions of a C-family translation unit, from a compiler's JSON syntax tree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from assayer.operators.facts import merge_functions

FUNCTIONS = "file string, name string, stable_symbol string, start_line int, end_line int, complexity int, parameter_count int"
FUNCTION_KINDS = frozenset(("FunctionDecl", "CXXMethodDecl", "CXXConstructorDecl", "CXXDestructorDecl", "CXXConversionDecl", "ObjCMethodDecl"))
ANONYMOUS_KINDS = frozenset(("LambdaExpr", "BlockExpr", "BlockDecl"))
SCOPE_KINDS = frozenset(("NamespaceDecl", "CXXRecordDecl", "ClassTemplateSpecializationDecl", "ObjCInterfaceDecl", "ObjCImplementationDecl", "ObjCCategoryDecl", "ObjCCategoryImplDecl"))
BODY_KINDS = frozenset(("CompoundStmt", "CXXTryStmt", "CoroutineBodyStmt", "SEHTryStmt"))
DECISION_KINDS = frozenset(
    "IfStmt ForStmt WhileStmt DoStmt CXXForRangeStmt ObjCForCollectionStmt CaseStmt ConditionalOperator BinaryConditionalOperator CXXCatchStmt ObjCAtCatchStmt SEHExceptStmt".split()
)


def decisions(node: dict) -> int:
    """Decision points below a node; functions and lambdas inside it are not its own."""
    total, left = 0, [node]
    while left:
        n = left.pop()
        if n.get("kind") in FUNCTION_KINDS or n.get("kind") in ANONYMOUS_KINDS:
            continue
        total += n.get("kind") in DECISION_KINDS or n.get("kind") == "BinaryOperator" and n.get("opcode") in ("&&", "||")
        left += n.get("inner", ())
    return total


def functions_of(file: str, tree: dict) -> list[tuple]:
    out: list[tuple] = []

    def visit(node: dict, scope: list[str]) -> None:
        kind = node.get("kind")
        if kind in FUNCTION_KINDS:
            body = [c for c in node.get("inner", ()) if c.get("kind") in BODY_KINDS]
            if body:
                name = "::".join([*scope, node.get("name", "")])
                signature = " ".join(node.get("type", {}).get("qualType", "").split()) or node.get("mangledName")
                span = node.get("range", {})
                out.append((file, name, f"{name}[type:{signature}]" if signature else name, span.get("begin", {}).get("line", 0), span.get("end", {}).get("line", 0), 1 + sum(map(decisions, body)), sum(c.get("kind") == "ParmVarDecl" for c in node.get("inner", ()))))
        inner = [*scope, node["name"]] if kind in SCOPE_KINDS and node.get("name") else scope
        for c in node.get("inner", ()):
            visit(c, inner)

    visit(tree, [])
    return out


def functions(trees: DataFrame) -> DataFrame:
    """``trees``: file, ast (JSON text), one row for each translation unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for f, t in zip(b.file, b.ast, strict=True) for r in functions_of(f, json.loads(t))], columns=[c.split()[0] for c in FUNCTIONS.split(", ")])

    return trees.select("file", "ast").mapInPandas(run, FUNCTIONS)


def merged(rows: DataFrame) -> DataFrame:
    """A function met in several units once, with the greatest complexity."""
    return merge_functions(rows)
