"""Row-local numeric rules (T1-T10) as Spark column expressions.

Rules apply in order and chain on the same column. Every input first goes through
a lenient numeric coercion (bad text becomes NULL); guards keep out-of-domain
inputs NULL the way the reference's NumPy path yields NaN, and ``log1p(-1)`` is
negative infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported rule kinds.
TRANSFORM_KINDS = ("log", "log1p", "sqrt", "square", "abs", "multiply", "divide", "add", "subtract")
VALUE_KINDS = ("multiply", "divide", "add", "subtract")


def to_numeric(c: Column) -> Column:
    """Coerce to double; unparseable text becomes NULL (never raises under ANSI)."""
    return c.try_cast("double")


def validate_rule(rule: dict) -> None:
    kind = rule.get("kind")
    if kind not in TRANSFORM_KINDS:
        raise ValueError(f"Unsupported transform kind {kind!r}; supported: {', '.join(TRANSFORM_KINDS)}")
    if kind in VALUE_KINDS:
        if rule.get("value") is None:
            raise ValueError(f"Transform {kind!r} on {rule.get('feature')!r} needs a numeric value")
        if kind == "divide" and float(rule["value"]) == 0.0:
            raise ValueError(f"Transform 'divide' on {rule.get('feature')!r} by zero is refused")


def apply_rule(c: Column, kind: str, value: float | None = None) -> Column:
    x = to_numeric(c)
    if kind == "log":
        return F.when(x > 0, F.ln(x))
    if kind == "log1p":
        return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf")))
    if kind == "sqrt":
        return F.when(x >= 0, F.sqrt(x))
    if kind == "square":
        return x * x
    if kind == "abs":
        return F.abs(x)
    if kind == "multiply":
        return x * F.lit(float(value))
    if kind == "divide":
        return x / F.lit(float(value))
    if kind == "add":
        return x + F.lit(float(value))
    if kind == "subtract":
        return x - F.lit(float(value))
    return x


def apply_rules(c: Column, rules: Sequence[dict]) -> Column:
    out = c
    for rule in rules:
        out = apply_rule(out, rule["kind"], rule.get("value"))
    return out


def sql_apply_rule(expr: str, kind: str, value: float | None = None) -> str:
    x = f"TRY_CAST({expr} AS DOUBLE)"
    if kind == "log":
        return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"
    if kind == "log1p":
        return f"(CASE WHEN {x} > -1 THEN ln(1 + {x}) WHEN {x} = -1 THEN CAST('-inf' AS DOUBLE) END)"
    if kind == "sqrt":
        return f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)"
    if kind == "square":
        return f"({x} * {x})"
    if kind == "abs":
        return f"abs({x})"
    op = {"multiply": "*", "divide": "/", "add": "+", "subtract": "-"}[kind]
    return f"({x} {op} CAST({float(value)!r} AS DOUBLE))"
