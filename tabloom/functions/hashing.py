"""Portable row hashes.

``row_hash`` takes the first 15 hex digits of ``md5(key1:key2:...:salt)`` as a
non-negative BIGINT in [0, 2**60). The same number is produced by DuckDB with
``CAST(('0x' || substr(md5(...), 1, 15)) AS UBIGINT)::BIGINT``, which is what lets
the random splits, folds and random baselines be checked by SQL. Keys should be
integer or string columns (the text form of doubles differs between engines).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPAN = float(1 << HASH_BITS)


def row_hash(key_cols: Sequence[str | Column], salt: str | int = 42) -> Column:
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in key_cols]
    text = F.concat_ws(":", *parts, F.lit(str(salt)))
    # never NULL (concat_ws skips NULLs); coalesce makes that visible to Catalyst so
    # no inferred isnotnull() filter evaluates the md5 a second time per row
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def unit_hash(key_cols: Sequence[str | Column], salt: str | int = 42) -> Column:
    """Uniform number in [0, 1) from ``row_hash``."""
    return row_hash(key_cols, salt).cast("double") / F.lit(HASH_SPAN)


def all_columns_hash(columns: Sequence[str]) -> Column:
    """Fallback row identity when no key is given: identical rows are interchangeable,
    so results stay deterministic as multisets. Not portable to SQL."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    return F.pmod(h, F.lit(1 << HASH_BITS)).cast("bigint")


def sql_row_hash(key_exprs: Sequence[str], salt: str | int = 42) -> str:
    """DuckDB text of ``row_hash`` for oracle queries."""
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key_exprs)
    return f"CAST(('0x' || substr(md5({parts} || ':{salt}'), 1, 15)) AS UBIGINT)::BIGINT"
