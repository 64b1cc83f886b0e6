"""Evaluation.

Classification metrics come from one ``groupBy(actual, prediction).count()``, the
confusion table, which is bounded by classes squared; regression metrics from one
sums aggregate. Both are exact and run on any number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metric names per task and their direction (higher is better?).
METRICS = {
    "classification": ("accuracy", "balanced_accuracy", "f1_macro"),
    "regression": ("rmse", "mae", "r2"),
}
HIGHER_IS_BETTER = {"accuracy": True, "balanced_accuracy": True, "f1_macro": True,
                    "rmse": False, "mae": False, "r2": True}


MAX_PIVOT = 1_000  # columns of a pivoted confusion table


def confusion(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Observed (actual, prediction) pairs with counts."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """A1-A3 as one row. Balanced accuracy averages recall over the classes present
    in ``actual``; macro F1 averages over actual-or-predicted labels, 0 where undefined."""
    conf = confusion(df, actual, prediction)
    # every confusion cell counts once for its actual label and once for its predicted
    # label; one grouped sum over the (tiny) confusion table gives tp, na, np per label
    same = F.col("actual").eqNullSafe(F.col("prediction"))
    cells = conf.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("na"), F.lit(0).cast("bigint").alias("np")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("na"), F.col("n").alias("np")))))
    per = cells.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("na").alias("na"), F.sum("np").alias("np"))
    denom = 2 * F.col("tp") + (F.col("np") - F.col("tp")) + (F.col("na") - F.col("tp"))
    return per.agg(
        (F.sum("tp") / F.sum("na")).alias("accuracy"),
        F.avg(F.when(F.col("na") > 0, F.col("tp") / F.col("na"))).alias("balanced_accuracy"),
        F.avg(F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(F.lit(0.0))).alias("f1_macro"),
    )


def regression_metrics(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """A4-A6 as one row; r2 = 1 - SSE/SST, with SST = 0 giving 1 if SSE = 0 else 0."""
    y, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    e = y - p
    s = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
               (F.var_pop(y) * F.count(y)).alias("sst"))
    r2 = (F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return s.select(F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def evaluate(df: DataFrame, task_type: str, actual: str = "actual", prediction: str = "prediction") -> dict[str, float]:
    m = (classification_metrics if task_type == "classification" else regression_metrics)(df, actual, prediction)
    row = m.collect()[0].asDict()
    return {k: (None if v is None else float(v)) for k, v in row.items()}


def confusion_pivot(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """A10: crosstab, zero filled; pivot values (bounded by #classes) are listed up front."""
    conf = confusion(df, actual, prediction)
    rows = conf.select("prediction").distinct().limit(MAX_PIVOT + 1).collect()
    if len(rows) > MAX_PIVOT:
        raise ValueError(f"a pivot of more than {MAX_PIVOT} predicted labels; use confusion() instead")
    labels = sorted({r["prediction"] for r in rows}, key=lambda v: (v is None, v))
    return conf.groupBy("actual").pivot("prediction", labels).agg(F.sum("n")).fillna(0)


def metric_long(task_type: str, series: dict[str, DataFrame]) -> DataFrame:
    """``metric, series, value`` from one metrics row per series."""
    out = None
    for name, row in series.items():
        metrics = METRICS[task_type]
        long = row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                             for m in metrics]))).withColumn("series", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out


def prediction_histogram(df: DataFrame, lo: float, hi: float, bins: int = 50,
                         actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """A14 at scale: a 2-D histogram of (actual, predicted) instead of every point."""
    width = (hi - lo) / bins

    def b(c):
        return F.least(F.greatest(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b(actual).alias("actual_bin"), b(prediction).alias("predicted_bin")).agg(F.count(F.lit(1)).alias("n"))


def cross_validated(scores_by_fold: DataFrame) -> DataFrame:
    """The mean of per-fold scores (not pooled)."""
    cols = [c for c in scores_by_fold.columns if c != "fold"]
    return scores_by_fold.agg(*[F.avg(c).alias(c) for c in cols])


def rank_trials(trials: DataFrame, metric: str) -> DataFrame:
    """H8: rank (min method) of trials by mean score; trial table is bounded by the grid."""
    higher = HIGHER_IS_BETTER[metric]
    order = F.desc("cv_metric") if higher else F.asc("cv_metric")
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return trials.withColumn("rank", F.rank().over(w).cast("bigint"))
