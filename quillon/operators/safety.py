"""Checks of requests, commands, paths and records."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markdown import sanitised  # noqa: F401

# Patterns of each family; a family raises one flag.
INJECTION = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    r"(?i)disregard\s+(all\s+)?previous\s+instructions",
    r"(?i)you\s+are\s+now\s+(a|an)\s+\w+\s*(mode|ai|bot|assistant)?",
    r"(?i)your\s+new\s+(instructions?|role|task|system)\s+(is|are)",
    r"(?i)\b(override|bypass)\s+(system\s+prompt|safety\s+filter|content\s+filter)",
    r"(?i)pretend\s+(you\s+have\s+no|there\s+are\s+no)\s+(restrictions?|limits?|filters?)",
)
COMMANDS = (r"`[^`]{1,200}`", r"\$\([^)]{1,200}\)", r"\|\s*(sh|bash|zsh)\s*$", r"(?i)&&\s*(rm|mkfs|dd|wget|curl)\b")
CREDENTIALS = (
    r"(?i)\b(reveal|output|print|show|send|leak)\s+(your\s+)?(api\s*key|password|secret|credentials?|token)",
    r"(?i)verify\s+(your|the)\s+(password|credentials|api\s*key|secret|token)",
    r"(?i)what\s+is\s+your\s+(api\s*key|password|secret|token)",
)
FAMILIES = (("potential-injection", INJECTION), ("potential-command-injection", COMMANDS), ("potential-credential-harvesting", CREDENTIALS))
DENIED = (r"rm\s+-rf\s+", r"mkfs\s+", r"dd\s+", r"chmod\s+777\s+", r"useradd\s+", r"userdel\s+", r"passwd\s+")
DENIED_CLUSTER = (r"kubectl\s+run\s+.*--generator=run-pod/v1", r"kubectl\s+delete\s+--all", r"kubectl\s+create\s+serviceaccount\s+.*--cluster-role=cluster-admin")
LONGEST_TASK = 10_000


def any_of(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def flags(text: Column) -> Column:
    return F.filter(F.array(*(F.when(any_of(text, ps), name) for name, ps in FAMILIES)), lambda x: x.isNotNull())


def injection_scan(text: Column, strict: bool = False) -> Column:
    """struct(flags, is_safe, risk): blocked at two flags, at one if strict."""
    found = flags(text)
    blocked = F.size(found) >= (1 if strict else 2)
    risk = F.when(F.size(found) == 0, "low").when(~blocked, "medium").when(F.array_contains(found, FAMILIES[1][0]), "critical").otherwise("high")
    return F.struct(found.alias("flags"), (~blocked).alias("is_safe"), risk.alias("risk"))


def validate_request(task: Column, allowed: Column, wanted: Column) -> Column:
    """struct(is_safe, risk, flag): the first check that fails decides."""
    scan = injection_scan(task)
    outside = (F.size(allowed) > 0) & F.exists(wanted, lambda c: ~F.array_contains(allowed, c))
    bad = lambda risk, flag: F.struct(F.lit(False).alias("is_safe"), F.lit(risk).alias("risk"), F.lit(flag).alias("flag"))
    return (
        F.when(F.coalesce(F.trim(task), F.lit("")) == "", bad("critical", "empty-task"))
        .when(F.length(task) > LONGEST_TASK, bad("high", "task-too-long"))
        .when(~scan["is_safe"], F.struct(F.lit(False).alias("is_safe"), scan["risk"].alias("risk"), F.array_join(scan["flags"], "+").alias("flag")))
        .when(outside, bad("high", "category-not-allowed"))
        .otherwise(F.struct(F.lit(True).alias("is_safe"), F.lit("low").alias("risk"), F.lit("").alias("flag")))
    )


def path_allowed(path: Column, folders: list[str]) -> Column:
    inside = F.lit(False)
    for f in folders:
        inside = inside | path.startswith(f.rstrip("/") + "/")
    return ~path.contains("..") & ~path.startswith("/") & inside


def allow_listed(value: Column, allowed: Column) -> Column:
    return (F.size(allowed) == 0) | F.array_contains(allowed, value)


def schema_errors(record: Column, schema: str) -> Column:
    """Errors of a JSON record against required fields and declared types; unknown fields are ignored."""
    rules = json.loads(schema)
    if not isinstance(rules, dict):
        return F.array().cast("array<string>")
    kinds = {"string": str, "number": (int, float), "boolean": bool, "object": dict, "array": list}

    def one(text):
        try:
            row = json.loads(text or "null")
        except ValueError:
            return ["not JSON"]
        if not isinstance(row, dict):
            return ["not an object"]
        out = [f"missing {k}" for k in rules.get("required", []) if k not in row]
        for k, v in rules.get("properties", {}).items():
            ok = kinds.get(v.get("type"))
            if k in row and ok and (not isinstance(row[k], ok) or ok is not bool and isinstance(row[k], bool)):
                out.append(f"{k} is not {v['type']}")
        return out

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "array<string>")(record)
