"""No-feature baselines (B1-B6), fitted on training labels only.

Predictions are row-local expressions: a literal for the mode/median/mean
baselines, and a hash-driven draw for the random ones. A seeded NumPy generator
cannot be reproduced across partitions, so each row's draw comes from
``unit_hash(key, seed)``; the draw is identical on any partitioning and in the SQL
oracle. The class table (labels, priors, cumulative priors) is bounded by the
number of classes and checked before it is turned into literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tabloom.functions.hashing import unit_hash

MAX_CLASSES = 10_000

# Baseline strategy names.
CLASSIFICATION_STRATEGIES = ("most_frequent", "uniform_random", "stratified_random")
REGRESSION_STRATEGIES = ("median_value", "mean_value")


def class_priors(train: DataFrame, target: str) -> DataFrame:
    """``label, n, prior, cum_prior``; NULL labels counted but given no prior.

    Cumulative priors are running integer counts divided once by the total, so
    they do not depend on the order floating-point additions happen in. At most MAX_CLASSES classes."""
    rows = [(r["label"], r["n"], r["prior"], r["cum_prior"]) for r in _collect_classes(train, target)]
    kind = train.schema[target].dataType
    return train.sparkSession.createDataFrame(rows, StructType([StructField("label", kind), StructField("n", LongType()), StructField("prior", DoubleType()), StructField("cum_prior", DoubleType())]))


def _collect_classes(train: DataFrame, target: str) -> list[dict]:
    """The class table in the order of the labels, NULL first; its size is checked before it is fetched."""
    rows = train.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"there are more classes than the baseline limit of {MAX_CLASSES}")
    out, run, whole = [], 0, sum(r["n"] for r in rows if r["label"] is not None)
    for r in sorted(rows, key=lambda r: (r["label"] is not None, r["label"])):
        known = r["label"] is not None
        run += r["n"] if known else 0
        out.append({"label": r["label"], "n": r["n"], "prior": r["n"] / whole if known else None, "cum_prior": run / whole if known else None})
    return out


def baseline_prediction(train: DataFrame, target: str, task_type: str, strategy: str,
                        key_cols: Sequence[str], seed: int = 42) -> Column:
    """Column expression that predicts for any row (uses ``key_cols`` for random draws)."""
    if task_type == "classification":
        rows = _collect_classes(train, target)
        labelled = [r for r in rows if r["label"] is not None]
        if strategy == "most_frequent":
            # mode with NULL allowed; ties go to the smallest label (NULL first)
            best = min(rows, key=lambda r: (-r["n"], r["label"] is not None, r["label"]))
            return F.lit(best["label"])
        u = unit_hash(key_cols, f"baseline:{seed}")
        if strategy == "uniform_random":
            k = len(labelled)
            idx = F.floor(u * F.lit(k)).cast("int")
            arr = F.array(*[F.lit(r["label"]) for r in labelled])
            return F.element_at(arr, idx + 1)
        if strategy == "stratified_random":
            # the label's place is the number of cumulative priors that the draw has reached
            labels = F.array(*[F.lit(r["label"]) for r in labelled])
            bounds = F.array(*[F.lit(float(r["cum_prior"])) for r in labelled[:-1]]).cast("array<double>")
            return F.element_at(labels, F.size(F.filter(bounds, lambda c: c <= u)) + 1)
        raise ValueError(f"Unsupported classification baseline strategy: {strategy}")
    if strategy == "median_value":
        from tabloom.operators.quantile import exact_quantiles
        m = exact_quantiles(train.select(F.col(target).cast("double").alias("_y")), {"_y": [0.5]})[("_y", 0.5)]
        return F.lit(m).cast("double")
    if strategy == "mean_value":
        m = train.agg(F.avg(F.col(target).cast("double")).alias("m")).collect()[0]["m"]
        return F.lit(m).cast("double")
    raise ValueError(f"Unsupported regression baseline strategy: {strategy}")


def choose_baseline_strategy(task_type: str, selected_metric: str) -> str:
    """R8."""
    if task_type == "classification":
        return "stratified_random"
    return "median_value" if selected_metric == "mae" else "mean_value"
