"""Lenient date parsing and date parts.

Each value is parsed on its own against an ordered list of patterns; the first
pattern that parses wins and a value no pattern accepts becomes NULL. Plain
``cast``/``try_cast`` is not used: Spark accepts a bare year such as ``'2026'`` as a
timestamp and the SQL oracle does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

# Accepted text patterns, in the order they are tried (Spark syntax,
# then the equivalent DuckDB strptime syntax used by the oracle queries).
DEFAULT_DATE_FORMATS: tuple[str, ...] = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "M/d/yyyy",
    "yyyy/M/d",
)
SQL_DATE_FORMATS: tuple[str, ...] = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%m/%d/%Y",
    "%Y/%m/%d",
)

DATE_PARTS: tuple[str, ...] = ("year", "month", "day", "dayofweek")

TEMPORAL_TYPES = (TimestampType, TimestampNTZType, DateType)


def is_temporal(dtype: DataType) -> bool:
    return isinstance(dtype, TEMPORAL_TYPES)


def lenient_timestamp(col: str | Column, dtype: DataType | None = None,
                      formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if dtype is not None and is_temporal(dtype):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string")) if dtype is None or not isinstance(dtype, StringType) else F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def order_micros(col: Column, dtype: DataType | None) -> Column:
    """A BIGINT ordering key for a date-like column: instants (``TIMESTAMP``) by their
    epoch microseconds, wall-clock values (``TIMESTAMP_NTZ``, dates, parsed text) by
    their wall-clock microseconds, so the order never depends on the session time zone."""
    if isinstance(dtype, TimestampType):
        return F.unix_micros(col)
    ts = lenient_timestamp(col, dtype)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def date_part_columns(ts: Column, prefix: str) -> list[Column]:
    """``<prefix>__year``, ``__month``, ``__day``, ``__dayofweek`` (Monday = 0), as doubles."""
    return [
        F.year(ts).cast("double").alias(f"{prefix}__year"),
        F.month(ts).cast("double").alias(f"{prefix}__month"),
        F.dayofmonth(ts).cast("double").alias(f"{prefix}__day"),
        F.weekday(ts).cast("double").alias(f"{prefix}__dayofweek"),
    ]


def sql_lenient_timestamp(expr: str, formats: Sequence[str] = SQL_DATE_FORMATS) -> str:
    inner = ", ".join(f"try_strptime(trim(CAST({expr} AS VARCHAR)), '{f}')" for f in formats)
    return f"coalesce({inner})"
