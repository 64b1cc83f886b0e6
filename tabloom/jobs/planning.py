"""Planning jobs: recommendations over a catalog of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import sql_row_hash
from tabloom.functions.dates import sql_lenient_timestamp
from tabloom.jobs import job
from tabloom.jobs import fixtures as fx
from tabloom.operators.profile import Brief
from tabloom.plans.recommend import profile_catalog, recommend, recommended_parameters, recommended_training

# (dataset_id, brief, key, schema facts for the oracle: typed-date columns, text columns,
#  columns whose name matches the identifier pattern, all feature columns)
DATASETS = [
    ("documents_quality", Brief("docs", "quality", "classification", competition_enabled=True), "doc_id",
     [], ["lang", "source", "text"], ["doc_id"], ["doc_id", "toxic", "lang", "source", "n_chars", "text"]),
    ("events_value", Brief("events", "value", "regression", date_column="ts"), "event_id",
     ["ts"], ["event_type", "props"], ["event_id", "user_id"], ["event_id", "ts", "user_id", "event_type", "props"]),
    ("orders_priority", Brief("orders", "o_orderpriority", "classification", baseline_metric="accuracy",
                              competition_enabled=True), "o_orderkey",
     ["o_orderdate"], ["o_orderstatus"], [], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]),
]


def _frames(spark, sf_dir):
    return {
        "documents_quality": fx.labelled_documents(spark, sf_dir),
        "events_value": fx.table(spark, sf_dir, "events"),
        "orders_priority": fx.table(spark, sf_dir, "orders"),
    }


_SOURCES = {"documents_quality": "labelled", "events_value": "events", "orders_priority": "orders"}


def summary_sql(i: int, ds, src: str) -> str:
    did, brief, key, typed_dates, texts, id_names, feats = ds
    h = sql_row_hash([key])
    n = f"(SELECT count(*) FROM {src})"
    nd = {c: f"(SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM {src})" for c in feats}
    probe = " + ".join(
        f"""(SELECT CASE WHEN avg(CASE WHEN {sql_lenient_timestamp('v')} IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 1 ELSE 0 END
     FROM (SELECT v, row_number() OVER (ORDER BY h, v) AS rn FROM
           (SELECT CAST({c} AS VARCHAR) AS v, {h} AS h FROM {src} WHERE {c} IS NOT NULL)) WHERE rn <= 250)"""
        for c in texts) or "0"
    date_like = f"({len(typed_dates)} + {probe})"
    ident = " + ".join(f"(CASE WHEN {nd[c]} / greatest({n}, 1) >= 0.5 THEN 1 ELSE 0 END)" for c in id_names) or "0"
    const = " + ".join(f"(CASE WHEN {nd[c]} <= 1 THEN 1 ELSE 0 END)" for c in feats)
    thr = f"greatest(20, least(100, CAST(floor({n} * 0.1) AS BIGINT)))"
    high = " + ".join(f"(CASE WHEN {nd[c]} >= {thr} AND {nd[c]} / {n} >= 0.1 THEN 1 ELSE 0 END)" for c in texts) or "0"
    miss = " + ".join(f"(SELECT count(*) - count({c}) FROM {src})" for c in feats)
    t = brief.target
    imb = (f"(SELECT CAST(max(k) AS DOUBLE) / min(k) FROM (SELECT count(*) AS k FROM {src} GROUP BY {t}))"
           if brief.task_type == "classification" else "CAST(NULL AS DOUBLE)")
    skew = f"(SELECT skewness({t}) FROM {src})" if brief.task_type == "regression" else "CAST(NULL AS DOUBLE)"
    q = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    return f"""s{i} AS (SELECT '{did}' AS dataset_id, '{brief.task_type}' AS task_type, {q(brief.date_column)} AS date_column,
  {q(brief.baseline_metric)} AS baseline_metric, {str(bool(brief.competition_enabled)).lower()} AS competition_enabled,
  {n} AS rows, {len(texts) + len(typed_dates)} AS n_categorical, {ident} AS n_identifier, {date_like} AS n_date_like,
  {const} AS n_constant, {high} AS n_high_card, CAST(({miss}) AS DOUBLE) / ({n} * {len(feats)}) AS missing_fraction,
  {imb} AS class_imbalance, {skew} AS target_skew)"""


_RULES_SQL = """
r AS (SELECT dataset_id, task_type, rows, class_imbalance,
  CASE WHEN n_identifier + n_date_like + n_constant + n_high_card > 0 THEN 'custom'
       WHEN missing_fraction = 0 THEN 'minimal_cleanup' ELSE 'auto_tabular_preprocessing' END AS pre,
  CASE WHEN coalesce(date_column, '') <> '' THEN 'time_ordered_holdout'
       WHEN task_type = 'classification' THEN 'stratified_holdout' ELSE 'random_holdout' END AS split,
  CASE WHEN coalesce(baseline_metric, '') <> '' THEN baseline_metric
       WHEN task_type = 'classification' THEN CASE WHEN coalesce(class_imbalance, 0) >= 1.5 THEN 'balanced_accuracy' ELSE 'f1_macro' END
       WHEN target_skew IS NOT NULL AND NOT isnan(target_skew) AND abs(target_skew) >= 1 THEN 'mae' ELSE 'rmse' END AS metric,
  CASE WHEN task_type = 'classification' THEN
         CASE WHEN rows >= 50000 THEN 'hist_gradient_boosting_classifier'
              WHEN n_categorical = 0 AND rows <= 10000 THEN 'logistic_regression'
              WHEN n_high_card > 0 OR rows >= 5000 THEN 'hist_gradient_boosting_classifier'
              ELSE 'random_forest_classifier' END
       ELSE CASE WHEN rows >= 50000 THEN 'hist_gradient_boosting_regressor'
              WHEN n_categorical = 0 AND rows <= 10000 THEN 'ridge_regression'
              WHEN target_skew IS NOT NULL AND NOT isnan(target_skew) AND abs(target_skew) >= 1 THEN 'hist_gradient_boosting_regressor'
              ELSE 'random_forest_regressor' END END AS model,
  CASE WHEN rows > 10000 THEN 'thorough_training' ELSE 'standard_training' END AS training,
  CASE WHEN competition_enabled THEN 'small_competition' ELSE 'skip' END AS hpo FROM s),
steps AS (SELECT dataset_id, step_id, CAST(step_number AS BIGINT) AS step_number, title, selected_option, options FROM (
  SELECT dataset_id, '00_intake' AS step_id, 0 AS step_number, 'Intake' AS title, 'structured_brief' AS selected_option, 'structured_brief' AS options FROM r
  UNION ALL SELECT dataset_id, '01_preprocessing', 1, 'Preprocessing', pre, 'auto_tabular_preprocessing,minimal_cleanup,custom' FROM r
  UNION ALL SELECT dataset_id, '02_data_splitting', 2, 'Data splitting', split, 'stratified_holdout,random_holdout,time_ordered_holdout' FROM r
  UNION ALL SELECT dataset_id, '03_model_selection', 3, 'Model selection', model,
     CASE WHEN task_type = 'classification' THEN 'logistic_regression,random_forest_classifier,hist_gradient_boosting_classifier,mlp_classifier'
          ELSE 'ridge_regression,random_forest_regressor,hist_gradient_boosting_regressor,mlp_regressor' END FROM r
  UNION ALL SELECT dataset_id, '05_metric_selection', 4, 'Metric selection', metric,
     CASE WHEN task_type = 'classification' THEN 'balanced_accuracy,f1_macro,accuracy' ELSE 'rmse,mae,r2' END FROM r
  UNION ALL SELECT dataset_id, '06_training_configuration', 5, 'Training', training, 'fast_training,standard_training,thorough_training' FROM r
  UNION ALL SELECT dataset_id, '08_validation_and_baseline', 6, 'Validation', 'test_set_with_baseline', 'test_set_with_baseline' FROM r
  UNION ALL SELECT dataset_id, '07_hyperparameter_optimization', 7, 'Hyperparameter optimization', hpo, 'skip,small_competition,expanded_competition' FROM r
  UNION ALL SELECT dataset_id, '09_final_validation', 9, 'Final validation', 'final_validation_dashboard', 'final_validation_dashboard' FROM r))"""


def rules_sql(datasets: int, then: str) -> str:
    """The rules over the summaries s0, s1, ..., then a query on ``r`` (a row per dataset) or ``steps``."""
    return ", s AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(datasets)) + ")," + _RULES_SQL + then


@job("recommend_steps", "WITH " + fx.LABELLED_DOCUMENTS_SQL + ",\n"
     + ",\n".join(summary_sql(i, ds, _SOURCES[ds[0]]) for i, ds in enumerate(DATASETS)) + rules_sql(len(DATASETS), " SELECT * FROM steps"))
def recommend_steps(spark, sf_dir):
    """Three datasets profiled, summarised, and planned in one rules projection."""
    frames = _frames(spark, sf_dir)
    summary = profile_catalog(spark, [(did, brief, frames[did], [key]) for did, brief, key, *_ in DATASETS])
    return recommend(summary)


_PLANNED = "WITH " + fx.LABELLED_DOCUMENTS_SQL + ",\n" + ",\n".join(summary_sql(i, ds, _SOURCES[ds[0]]) for i, ds in enumerate(DATASETS))


def _summary(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return profile_catalog(spark, [(did, brief, frames[did], [key]) for did, brief, key, *_ in DATASETS])


@job("recommend_parameters", _PLANNED + rules_sql(len(DATASETS), """,
f AS (SELECT *, CASE WHEN model LIKE 'random_forest%' THEN 'forest' WHEN model LIKE 'hist%' THEN 'boosting' WHEN model LIKE 'mlp%' THEN 'mlp' ELSE model END AS family FROM r)
SELECT dataset_id, model, parameter, value FROM (
  SELECT dataset_id, model, 'n_estimators' AS parameter, CASE WHEN rows <= 10000 THEN '300' ELSE '500' END AS value FROM f WHERE family = 'forest'
  UNION ALL SELECT dataset_id, model, 'max_depth', CASE WHEN rows <= 20000 THEN NULL ELSE '16' END FROM f WHERE family = 'forest'
  UNION ALL SELECT dataset_id, model, 'min_samples_leaf', CASE WHEN rows <= 5000 THEN '1' ELSE '2' END FROM f WHERE family = 'forest'
  UNION ALL SELECT dataset_id, model, 'max_depth', NULL FROM f WHERE family = 'boosting'
  UNION ALL SELECT dataset_id, model, 'max_leaf_nodes', '31' FROM f WHERE family = 'boosting'
  UNION ALL SELECT dataset_id, model, 'l2_regularization', '0.0' FROM f WHERE family = 'boosting'
  UNION ALL SELECT dataset_id, model, 'hidden_layer_sizes', '64,32' FROM f WHERE family = 'mlp'
  UNION ALL SELECT dataset_id, model, 'alpha', '0.0001' FROM f WHERE family = 'mlp'
  UNION ALL SELECT dataset_id, model, 'alpha', '1.0' FROM f WHERE family = 'ridge_regression'
  UNION ALL SELECT dataset_id, model, 'C', '1.0' FROM f WHERE family = 'logistic_regression'
  UNION ALL SELECT dataset_id, model, 'class_weight', CASE WHEN class_imbalance >= 1.5 THEN 'balanced' END FROM f WHERE family = 'logistic_regression')"""))
def recommend_parameters(spark, sf_dir):
    """The recommended model's default parameters, as rows."""
    return recommended_parameters(_summary(spark, sf_dir))


@job("recommend_training", _PLANNED + rules_sql(len(DATASETS), """,
f AS (SELECT *, CASE WHEN model LIKE 'random_forest%' THEN 'forest' WHEN model LIKE 'hist%' THEN 'boosting' WHEN model LIKE 'mlp%' THEN 'mlp' ELSE 'linear' END AS family FROM r),
d AS (SELECT *, CASE WHEN training = 'thorough_training' THEN 5 ELSE greatest(3, CASE WHEN rows > 2000 THEN 5 ELSE 3 END) END AS folds,
        CASE family WHEN 'linear' THEN 300 WHEN 'boosting' THEN 200 WHEN 'mlp' THEN 250 END AS base FROM f)
SELECT dataset_id, setting, value FROM (
  SELECT dataset_id, 'cv_folds' AS setting, CAST(folds AS VARCHAR) AS value FROM d
  UNION ALL SELECT dataset_id, 'random_seed', '42' FROM d
  UNION ALL SELECT dataset_id, 'optimizer', CASE WHEN family = 'mlp' THEN 'adam' END FROM d
  UNION ALL SELECT dataset_id, 'learning_rate', CASE family WHEN 'boosting' THEN '0.1' WHEN 'mlp' THEN '0.001' END FROM d
  UNION ALL SELECT dataset_id, 'epochs', CAST(CASE WHEN training = 'thorough_training' THEN CAST(floor(base * 1.25) AS INTEGER) ELSE base END AS VARCHAR) FROM d
  UNION ALL SELECT dataset_id, 'mini_batch', CASE WHEN family = 'mlp' THEN '32' END FROM d
  UNION ALL SELECT dataset_id, 'early_stopping', CASE WHEN family IN ('boosting', 'mlp') THEN 'true' ELSE 'false' END FROM d
  UNION ALL SELECT dataset_id, 'validation_fraction', '0.1' FROM d)"""))
def recommend_training(spark, sf_dir):
    """The recommended model's training settings under the recommended budget, as rows."""
    return recommended_training(_summary(spark, sf_dir))
