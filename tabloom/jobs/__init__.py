"""Registered jobs: each runs one library operator over the test tables and has,
where SQL can express it, an equivalent DuckDB query used as the correctness oracle.

``registry()`` imports every job module and returns ``{name: (fn, sql_or_None)}``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def job(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate job {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def registry() -> dict[str, tuple[Callable, str | None]]:
    for module in ("profiling", "planning", "preparation", "splitting", "evaluation", "modelling"):
        import_module(f"tabloom.jobs.{module}")
    return dict(REGISTRY)
