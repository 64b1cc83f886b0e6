"""Metric, baseline and cross-validation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import HASH_SPAN, sql_row_hash
from tabloom.jobs import job
from tabloom.jobs import fixtures as fx
from tabloom.jobs.sqlgen import fold_of
from tabloom.jobs.preparation import split_cte
from tabloom.operators.baseline import baseline_prediction, choose_baseline_strategy
from tabloom.operators.metrics import (
    classification_metrics, confusion, confusion_pivot, metric_long, regression_metrics,
)
from tabloom.operators.split import assign_folds, holdout_split
from tabloom.session import cut_lineage

R = 6

# a fixed rule standing in for a trained classifier / regressor (reads only the row)
STATUS_RULE_SQL = "CASE WHEN year(o_orderdate) <= 1996 THEN 'F' WHEN year(o_orderdate) <= 1998 THEN 'O' ELSE 'P' END"
PRICE_RULE_SQL = "l_quantity * 1000.0"


def _status_rule():
    y = F.year("o_orderdate")
    return F.when(y <= 1996, "F").when(y <= 1998, "O").otherwise("P")


def _orders_pred(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("actual"), _status_rule().alias("prediction"))


def _lineitem_pred(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1000.0).alias("prediction"))


def cls_metrics_sql(pred: str) -> str:
    return f"""conf AS (SELECT actual, prediction, count(*) AS n FROM {pred} GROUP BY ALL),
labs AS (SELECT actual AS label FROM conf UNION SELECT prediction FROM conf),
per AS (SELECT label,
   coalesce((SELECT sum(n) FROM conf WHERE actual IS NOT DISTINCT FROM label AND prediction IS NOT DISTINCT FROM label), 0) AS tp,
   coalesce((SELECT sum(n) FROM conf WHERE actual IS NOT DISTINCT FROM label), 0) AS na,
   coalesce((SELECT sum(n) FROM conf WHERE prediction IS NOT DISTINCT FROM label), 0) AS np FROM labs),
cm AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(na) AS accuracy,
   avg(CASE WHEN na > 0 THEN CAST(tp AS DOUBLE) / na END) AS balanced_accuracy,
   avg(CASE WHEN np + na > 0 THEN 2.0 * tp / (np + na) ELSE 0.0 END) AS f1_macro FROM per)"""


def reg_metrics_sql(pred: str) -> str:
    return f"""rm AS (SELECT sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse,
   avg(abs(actual - prediction)) AS mae,
   CASE WHEN var_pop(actual) * count(actual) > 0
        THEN 1 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(actual))
        WHEN sum((actual - prediction) * (actual - prediction)) = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM {pred})"""


def _round_all(df):
    return df.select(*[F.round(c, R).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@job("metrics_classification", f"WITH p AS (SELECT o_orderstatus AS actual, {STATUS_RULE_SQL} AS prediction FROM orders),\n"
     + cls_metrics_sql("p") + f"\nSELECT round(accuracy, {R}) AS accuracy, round(balanced_accuracy, {R}) AS balanced_accuracy, "
     f"round(f1_macro, {R}) AS f1_macro FROM cm")
def metrics_classification(spark, sf_dir):
    """A1-A3 from the confusion table."""
    return _round_all(classification_metrics(_orders_pred(spark, sf_dir)))


@job("metrics_regression", f"WITH p AS (SELECT l_extendedprice AS actual, {PRICE_RULE_SQL} AS prediction FROM lineitem),\n"
     + reg_metrics_sql("p") + f"\nSELECT round(rmse, {R}) AS rmse, round(mae, {R}) AS mae, round(r2, {R}) AS r2 FROM rm")
def metrics_regression(spark, sf_dir):
    """A4-A6 from one sums aggregate."""
    return _round_all(regression_metrics(_lineitem_pred(spark, sf_dir)))


@job("confusion_long", f"SELECT o_orderstatus AS actual, {STATUS_RULE_SQL} AS prediction, count(*) AS n FROM orders GROUP BY ALL")
def confusion_long(spark, sf_dir):
    """Observed (actual, prediction) pairs."""
    return confusion(_orders_pred(spark, sf_dir))


@job("confusion_pivot", f"""WITH p AS (SELECT o_orderstatus AS actual, {STATUS_RULE_SQL} AS prediction FROM orders)
SELECT actual, CAST(count(*) FILTER (WHERE prediction = 'F') AS BIGINT) AS F,
       CAST(count(*) FILTER (WHERE prediction = 'O') AS BIGINT) AS O,
       CAST(count(*) FILTER (WHERE prediction = 'P') AS BIGINT) AS P
FROM p GROUP BY actual""")
def confusion_pivot_job(spark, sf_dir):
    """A10: crosstab of actual x predicted, zero filled."""
    return confusion_pivot(_orders_pred(spark, sf_dir))


# ---- baselines -------------------------------------------------------------------------

H_BASE = sql_row_hash(["o_orderkey"], "baseline:42")
U_BASE = f"(CAST({H_BASE} AS DOUBLE) / {HASH_SPAN!r})"


def _orders_split(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return cut_lineage(holdout_split(o, ["o_orderkey"], "random_holdout"))


def _baseline_orders(spark, sf_dir, strategy):
    s = _orders_split(spark, sf_dir)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    pred = baseline_prediction(train, "o_orderpriority", "classification", strategy, ["o_orderkey"])
    return test.select("o_orderkey", pred.alias("prediction"))


_ORDERS_TRAIN = "WITH " + split_cte("orders", ["o_orderkey"]) + ",\ntr AS (SELECT * FROM sp WHERE split = 'train'),\nte AS (SELECT * FROM sp WHERE split = 'test')"


@job("baseline_most_frequent", _ORDERS_TRAIN + """
SELECT o_orderkey, (SELECT o_orderpriority FROM tr GROUP BY o_orderpriority
                    ORDER BY count(*) DESC, o_orderpriority NULLS FIRST LIMIT 1) AS prediction FROM te""")
def baseline_most_frequent(spark, sf_dir):
    """B1: training mode (ties -> smallest label)."""
    return _baseline_orders(spark, sf_dir, "most_frequent")


@job("baseline_uniform_random", _ORDERS_TRAIN + f""",
labs AS (SELECT list(o_orderpriority ORDER BY o_orderpriority) AS l
         FROM (SELECT DISTINCT o_orderpriority FROM tr WHERE o_orderpriority IS NOT NULL))
SELECT o_orderkey, l[CAST(floor({U_BASE} * len(l)) AS BIGINT) + 1] AS prediction FROM te, labs""")
def baseline_uniform_random(spark, sf_dir):
    """B2: uniform draw over the training labels from each row's hash."""
    return _baseline_orders(spark, sf_dir, "uniform_random")


@job("baseline_stratified_random", _ORDERS_TRAIN + f""",
cls AS (SELECT o_orderpriority AS label, count(*) AS n FROM tr WHERE o_orderpriority IS NOT NULL GROUP BY 1),
cp AS (SELECT label, CAST(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                     / sum(n) OVER () AS cum, row_number() OVER (ORDER BY label DESC) = 1 AS is_last FROM cls)
SELECT o_orderkey, (SELECT label FROM cp WHERE {U_BASE} < cum OR is_last ORDER BY label LIMIT 1) AS prediction FROM te""")
def baseline_stratified_random(spark, sf_dir):
    """Draw by training class priors (labels sorted) from each row's hash."""
    return _baseline_orders(spark, sf_dir, "stratified_random")


_LI_TRAIN = "WITH " + split_cte("lineitem", ["l_orderkey", "l_linenumber"], ties=[
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate"]) + ",\ntr AS (SELECT * FROM sp WHERE split = 'train'),\nte AS (SELECT * FROM sp WHERE split = 'test')"


def _baseline_li(spark, sf_dir, strategy):
    li = fx.table(spark, sf_dir, "lineitem")
    s = cut_lineage(holdout_split(li, ["l_orderkey", "l_linenumber"]))
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    pred = baseline_prediction(train, "l_extendedprice", "regression", strategy, ["l_orderkey", "l_linenumber"])
    return test.select("l_orderkey", "l_linenumber", F.round(pred, R).alias("prediction"))


@job("baseline_median", _LI_TRAIN + f"""
SELECT l_orderkey, l_linenumber, round((SELECT quantile_cont(l_extendedprice, 0.5) FROM tr), {R}) AS prediction FROM te""")
def baseline_median(spark, sf_dir):
    """Exact training median."""
    return _baseline_li(spark, sf_dir, "median_value")


@job("baseline_mean", _LI_TRAIN + f"""
SELECT l_orderkey, l_linenumber, round((SELECT avg(l_extendedprice) FROM tr), {R}) AS prediction FROM te""")
def baseline_mean(spark, sf_dir):
    """Training mean."""
    return _baseline_li(spark, sf_dir, "mean_value")


_STRAT_SQL = f""",
cls AS (SELECT o_orderpriority AS label, count(*) AS n FROM tr WHERE o_orderpriority IS NOT NULL GROUP BY 1),
cp AS (SELECT label, CAST(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                     / sum(n) OVER () AS cum, row_number() OVER (ORDER BY label DESC) = 1 AS is_last FROM cls),
bp AS (SELECT o_orderpriority AS actual,
              (SELECT label FROM cp WHERE {U_BASE} < cum OR is_last ORDER BY label LIMIT 1) AS prediction FROM te),
"""


@job("baseline_evaluation", _ORDERS_TRAIN + _STRAT_SQL + cls_metrics_sql("bp") + f"""
SELECT 'stratified_random' AS strategy, round(accuracy, {R}) AS accuracy,
       round(balanced_accuracy, {R}) AS balanced_accuracy, round(f1_macro, {R}) AS f1_macro FROM cm""")
def baseline_evaluation(spark, sf_dir):
    """B6 + R8: the chosen baseline scored on the holdout."""
    s = _orders_split(spark, sf_dir)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    strategy = choose_baseline_strategy("classification", "f1_macro")
    pred = baseline_prediction(train, "o_orderpriority", "classification", strategy, ["o_orderkey"])
    m = classification_metrics(test.select(F.col("o_orderpriority").alias("actual"), pred.alias("prediction")))
    return _round_all(m).select(F.lit(strategy).alias("strategy"), "*")


@job("model_vs_baseline", _ORDERS_TRAIN.replace("o_orderpriority", "o_orderstatus")
     + _STRAT_SQL.replace("o_orderpriority", "o_orderstatus")
     + cls_metrics_sql("bp") + ",\n"
     + f"mp AS (SELECT o_orderstatus AS actual, {STATUS_RULE_SQL} AS prediction FROM te),\n"
     + cls_metrics_sql("mp").replace("conf AS", "conf2 AS").replace("FROM conf", "FROM conf2")
       .replace("labs AS", "labs2 AS").replace("FROM labs", "FROM labs2").replace("per AS", "per2 AS")
       .replace("FROM per", "FROM per2").replace("cm AS", "cm2 AS") + f"""
SELECT m.metric, m.series, round(m.value, {R}) AS value FROM (
  SELECT 'accuracy' AS metric, 'model' AS series, accuracy AS value FROM cm2
  UNION ALL SELECT 'balanced_accuracy', 'model', balanced_accuracy FROM cm2
  UNION ALL SELECT 'f1_macro', 'model', f1_macro FROM cm2
  UNION ALL SELECT 'accuracy', 'baseline', accuracy FROM cm
  UNION ALL SELECT 'balanced_accuracy', 'baseline', balanced_accuracy FROM cm
  UNION ALL SELECT 'f1_macro', 'baseline', f1_macro FROM cm
  UNION ALL SELECT 'accuracy', 'delta', cm2.accuracy - cm.accuracy FROM cm, cm2
  UNION ALL SELECT 'balanced_accuracy', 'delta', cm2.balanced_accuracy - cm.balanced_accuracy FROM cm, cm2
  UNION ALL SELECT 'f1_macro', 'delta', cm2.f1_macro - cm.f1_macro FROM cm, cm2) m""")
def model_vs_baseline(spark, sf_dir):
    """Model and baseline metrics on the holdout, long form, plus the signed delta."""
    o = fx.table(spark, sf_dir, "orders")
    s = cut_lineage(holdout_split(o, ["o_orderkey"]))
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    base = baseline_prediction(train, "o_orderstatus", "classification", "stratified_random", ["o_orderkey"])
    mb = classification_metrics(test.select(F.col("o_orderstatus").alias("actual"), base.alias("prediction")))
    mm = classification_metrics(test.select(F.col("o_orderstatus").alias("actual"), _status_rule().alias("prediction")))
    long = metric_long("classification", {"model": mm, "baseline": mb})
    bm = {r["metric"]: r["value"] for r in long.where("series = 'baseline'").collect()}
    delta = long.where("series = 'model'").select(
        "metric", F.lit("delta").alias("series"),
        (F.col("value") - F.element_at(F.create_map(*[x for k, v in bm.items() for x in (F.lit(k), F.lit(v))]),
                                       F.col("metric"))).alias("value"))
    return long.select("metric", "series", "value").unionByName(delta).select(
        "metric", "series", F.round("value", R).alias("value"))


# ---- cross-validated scores (A8) --------------------------------------------------------------

def _folded_train(spark, sf_dir, k=5):
    li = fx.table(spark, sf_dir, "lineitem").select(*_CV_COLS)
    s = cut_lineage(holdout_split(li, ["l_orderkey", "l_linenumber"]))
    return cut_lineage(assign_folds(s.where("split = 'train'"), ["l_orderkey", "l_linenumber"], k))


_CV_COLS = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"]
_CV_TIE = ", ".join(["l_orderkey", "l_linenumber", *sorted(_CV_COLS)])
_FOLDS_SQL = "WITH " + split_cte("lineitem", ["l_orderkey", "l_linenumber"], ties=_CV_COLS) + f""",
tr AS (SELECT *, {fold_of(f"(row_number() OVER (ORDER BY {sql_row_hash(['l_orderkey', 'l_linenumber'], 'fold:42')}, {_CV_TIE}) - 1)", "(SELECT count(*) FROM sp WHERE split = 'train')", 5)} AS fold
       FROM sp WHERE split = 'train')"""


def cv_mean_predictor_scores(folded, target: str):
    """Per fold: predict the mean of the other training folds, score on the fold."""
    stats = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s")).collect()
    tot_n, tot_s = sum(r["n"] for r in stats), sum(r["s"] for r in stats)
    means = {r["fold"]: (tot_s - r["s"]) / (tot_n - r["n"]) for r in stats}
    m = F.create_map(*[x for f, v in means.items() for x in (F.lit(f), F.lit(float(v)))])
    pred = folded.select("fold", F.col(target).alias("actual"), F.element_at(m, F.col("fold")).alias("prediction"))
    e = F.col("actual") - F.col("prediction")
    per = pred.groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                                   F.sum(e * e).alias("sse"), (F.var_pop("actual") * F.count("actual")).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return per.select("fold", "rmse", "mae", r2.alias("r2"))


_CV_SQL = _FOLDS_SQL + """,
fs AS (SELECT fold, count(*) AS n, sum(l_extendedprice) AS s FROM tr GROUP BY fold),
mf AS (SELECT fold, ((SELECT sum(s) FROM fs) - s) / ((SELECT sum(n) FROM fs) - n) AS m FROM fs),
sc AS (SELECT tr.fold, sqrt(avg((l_extendedprice - m) * (l_extendedprice - m))) AS rmse, avg(abs(l_extendedprice - m)) AS mae,
              CASE WHEN var_pop(l_extendedprice) > 0 THEN 1 - sum((l_extendedprice - m) * (l_extendedprice - m)) / (var_pop(l_extendedprice) * count(*))
                   ELSE 0.0 END AS r2
       FROM tr JOIN mf ON tr.fold = mf.fold GROUP BY tr.fold)"""


@job("cv_score_by_fold", _CV_SQL + f"\nSELECT fold, round(rmse, {R}) AS rmse, round(mae, {R}) AS mae, round(r2, {R}) AS r2 FROM sc")
def cv_score_by_fold(spark, sf_dir):
    """A8 per fold: training-fold mean as predictor, scored on the held-out fold."""
    return _round_all(cv_mean_predictor_scores(_folded_train(spark, sf_dir), "l_extendedprice"))


@job("cv_score_mean", _CV_SQL + f"\nSELECT round(avg(rmse), {R}) AS rmse, round(avg(mae), {R}) AS mae, round(avg(r2), {R}) AS r2 FROM sc")
def cv_score_mean(spark, sf_dir):
    """The cross-validated score is the mean of per-fold scores."""
    from tabloom.operators.metrics import cross_validated
    per = cv_mean_predictor_scores(_folded_train(spark, sf_dir), "l_extendedprice")
    return _round_all(cross_validated(per.drop("fold")))
