"""Small helpers that write oracle SQL text (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence


def distinct_with_null(col: str) -> str:
    return f"(count(DISTINCT {col}) + max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END))"


def n_missing(col: str) -> str:
    return f"sum(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END)"


def per_column_stats(source: str, cols: Sequence[tuple[str, str]]) -> str:
    """One row per (column, role): distinct (NULL counted), missing, rows, min/max."""
    parts = []
    for pos, (c, role) in enumerate(cols):
        mn = f"CAST(min({c}) AS DOUBLE)" if role == "numeric" else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if role == "numeric" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, CAST({pos} AS BIGINT) AS pos, '{role}' AS role, "
            f"CAST({distinct_with_null(c)} AS BIGINT) AS n_distinct, CAST({n_missing(c)} AS BIGINT) AS n_missing, "
            f"CAST(count(*) AS BIGINT) AS n_rows, {mn} AS min_value, {mx} AS max_value FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def fold_of(rank0: str, n: str, k: int, before: str = "0") -> str:
    """Fold of the row of rank ``rank0`` (from 0) among ``n``: k stretches, the first n mod k one row longer, turned on by ``before``."""
    q, e = f"({n} // {k})", f"({n} % {k})"
    return (f"CAST((CASE WHEN {rank0} < {e} * ({q} + 1) THEN {rank0} // ({q} + 1) "
            f"ELSE {e} + ({rank0} - {e} * ({q} + 1)) // greatest({q}, 1) END + {before}) % {k} AS INTEGER)")
