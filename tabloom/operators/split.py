"""Holdouts and folds (X1-X8), as exact cuts of a row order (``cuts``): no row is shuffled.

* random holdout: the ``ceil(test_size * n)`` rows with the smallest row hash;
* stratified holdout: per-class quotas by largest remainder (tie -> smaller label)
  summing to exactly ``ceil(test_size * n)``, the smallest hashes of each class;
  falls back to random when there is one class or a class has a single row;
* time-ordered holdout: the first ``int(n * (1 - test_size))`` rows by parsed time
  (missing times last, ties by row hash) train, the rest test;
* k-fold: k stretches of the hash order, the first n mod k one row longer; stratified
  k-fold cuts each class like that and turns its folds on by the rows of the classes before
  it, so every fold gets its share of every class and all folds are equally large.

Row hashes come from ``row_hash(key_cols, salt)``; the same split is reproduced by
the SQL oracle with md5 and ``row_number()``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.dates import order_micros
from tabloom.functions.hashing import HASH_BITS, row_hash
from tabloom.operators.cuts import Key, find_cuts

MAX_CLASSES = 100_000
LONG_MAX = (1 << 63) - 1


def _class_counts(df: DataFrame, target: str) -> list[tuple]:
    rows = df.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"there are more classes than the stratification limit of {MAX_CLASSES}")
    return sorted(((r["label"], int(r["n"])) for r in rows), key=lambda kv: (kv[0] is not None, kv[0]))


def tie_columns(df: DataFrame, key_cols: Sequence[str]) -> list[str]:
    """Total order behind every rank: the key columns, then every other orderable
    column by name. Rows that still tie are identical and interchangeable, so
    results do not depend on partitioning even when the key is not unique."""
    from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType
    rest = sorted(f.name for f in df.schema.fields
                  if f.name not in key_cols and not f.name.startswith("_")
                  and not isinstance(f.dataType, (MapType, ArrayType, StructType, BinaryType)))
    return [*key_cols, *rest]


def largest_remainder_quotas(counts: Sequence[tuple], total: int) -> dict:
    n = sum(c for _, c in counts)
    base = {lab: (total * c) // n for lab, c in counts}
    rem = {lab: (total * c) % n for lab, c in counts}
    left = total - sum(base.values())
    order = sorted(counts, key=lambda kv: (-rem[kv[0]], kv[0] is not None, kv[0]))
    for lab, _ in order[:left]:
        base[lab] += 1
    return base


_HASH = Key("_h", 0, (1 << HASH_BITS) - 1, (1 << HASH_BITS) - 1)


def _side(cuts, split_col: str, first: str, second: str) -> DataFrame:
    return cuts.passed().withColumn(split_col, F.when(F.col("_passed") == 0, first).otherwise(second)).drop("_h", "_t", "_row", "_passed", "_extra")


def holdout_split(df: DataFrame, key_cols: Sequence[str], method: str = "random_holdout", *,
                  target: str | None = None, task_type: str | None = None, date_column: str | None = None,
                  test_size: float = 0.2, seed: int = 42, split_col: str = "split") -> DataFrame:
    """Add ``split_col`` in {'train', 'test'}."""
    d = df.withColumn("_h", row_hash(key_cols, seed))
    ties = tie_columns(df, key_cols)
    if method == "time_ordered_holdout":
        if not date_column or date_column not in df.columns:
            raise ValueError("Time-ordered holdout requires a valid date_column in the project brief.")
        micros = order_micros(F.col(date_column), df.schema[date_column].dataType)
        d = d.withColumn("_t", F.coalesce(micros, F.lit(LONG_MAX).cast("bigint")))
        n, low, usual = d.agg(F.count(F.lit(1)), F.min("_t"), F.max(F.when(F.col("_t") < LONG_MAX, F.col("_t")))).first()
        low = LONG_MAX if low is None else low
        time = Key("_t", low, LONG_MAX, low if usual is None else usual)
        return _side(find_cuts(d, [time, _HASH], ties, {None: [int(n * (1 - test_size))]}, {None: n}), split_col, "train", "test")

    if method == "stratified_holdout" and task_type == "classification" and target is not None:
        counts = _class_counts(df, target)
        nonnull = [c for lab, c in counts if lab is not None]
        if len(counts) > 1 and nonnull and min(nonnull) > 1:
            quotas = largest_remainder_quotas(counts, math.ceil(test_size * sum(c for _, c in counts)))
            return _side(find_cuts(d, [_HASH], ties, {lab: [q] for lab, q in quotas.items()}, dict(counts), target), split_col, "test", "train")
    n = df.count()
    return _side(find_cuts(d, [_HASH], ties, {None: [math.ceil(test_size * n)]}, {None: n}), split_col, "test", "train")


def fold_ends(n: int, k: int) -> list[int]:
    """Ranks of the last rows of all folds but the last: n rows in k stretches, the first n mod k one row longer."""
    return [f * (n // k) + min(f, n % k) for f in range(1, k)]


def fold_hash(key_cols: Sequence[str], seed: int = 42) -> Column:
    """The order that ``assign_folds`` cuts."""
    return row_hash(key_cols, f"fold:{seed}")


def assign_folds(df: DataFrame, key_cols: Sequence[str], k: int, *, target: str | None = None,
                 stratified: bool = False, seed: int = 42, fold_col: str = "fold", hash_col: str | None = None) -> DataFrame:
    """Add ``fold_col`` in [0, k). ``hash_col``: a column of ``df`` that holds ``fold_hash`` already; it is dropped."""
    d = df.withColumn("_h", fold_hash(key_cols, seed) if hash_col is None else F.col(hash_col))
    if hash_col is not None:
        df, d = df.drop(hash_col), d.drop(hash_col)
    by_class = stratified and target is not None
    sizes = dict(_class_counts(df, target)) if by_class else {None: df.count()}
    before, run = {}, 0
    for lab, n in sizes.items():
        before[lab], run = run, run + n
    cuts = find_cuts(d, [_HASH], tie_columns(df, key_cols), {lab: fold_ends(n, k) for lab, n in sizes.items()}, sizes, target if by_class else None, before)
    return cuts.passed().withColumn(fold_col, ((F.col("_passed") + F.col("_extra")) % k).cast("int")).drop("_h", "_row", "_passed", "_extra")


def split_summary(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return split_df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))


def leakage_check(split_df: DataFrame, key_cols: Sequence[str], split_col: str = "split") -> DataFrame:
    """One row: train rows, test rows, total, and the train rows whose key is in the test part too. One
    aggregate by key, so the split is worked out once."""
    side = lambda name: F.sum(F.when(F.col(split_col) == name, 1).otherwise(0)).cast("bigint")
    keys = split_df.groupBy(*[F.col(f"`{c}`") for c in key_cols]).agg(side("train").alias("_train"), side("test").alias("_test"), F.count(F.lit(1)).alias("_n"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    shared = F.when(F.col("_test") > 0, F.col("_train")).otherwise(0)
    known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in key_cols])  # a missing key is no one's double
    return keys.agg(whole("_train").alias("train_rows"), whole("_test").alias("test_rows"), whole("_n").alias("total_rows"),
                    whole(F.when(known, shared).otherwise(0)).alias("overlap_rows"))
