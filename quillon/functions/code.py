"""Measures of Python source; the code is parsed, never run."""
import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = "parses boolean, complexity int, has_try boolean, callables array<string>"


def metrics_of(code: str) -> dict:
    """Complexity is 1 and one for each branch, loop, handler, with block and further operand of a boolean expression."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"parses": False, "complexity": 0, "has_try": False, "callables": []}
    nodes = list(ast.walk(tree))
    branches = sum(isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With)) for n in nodes)
    operands = sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
    names = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not n.name.startswith("_")]
    return {"parses": True, "complexity": 1 + branches + operands, "has_try": any(isinstance(n, ast.Try) for n in nodes), "callables": names}


def code_metrics(code: Column) -> Column:
    def run(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metrics_of(c or "") for c in code], columns=["parses", "complexity", "has_try", "callables"])

    return F.pandas_udf(run, METRICS)(code)


def signature_of(case: str | None) -> str:
    """Parameters that fit the first test case's input."""
    try:
        value = json.loads(case or "{}").get("input")
    except (ValueError, AttributeError):
        return "(data)"
    if isinstance(value, dict):
        return "(" + ", ".join(sorted(value)) + ")"
    if isinstance(value, list):
        return "(rows: list[list])" if value and all(isinstance(v, list) for v in value) else "(items: list)"
    return "(text: str)" if isinstance(value, str) else "(number)" if isinstance(value, (int, float)) else "(data)"


def signature(case: Column) -> Column:
    def run(case: pd.Series) -> pd.Series:
        return case.map(signature_of)

    return F.pandas_udf(run, "string")(case)
