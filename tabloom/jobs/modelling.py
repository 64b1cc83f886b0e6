"""Model, tuning and workflow jobs.

Ridge regression jobs have closed-form SQL oracles; the tree, boosting and MLP
jobs are checked by row counts (their numbers are not comparable to another
engine's implementation).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import sql_row_hash
from tabloom.jobs import job
from tabloom.jobs import fixtures as fx
from tabloom.jobs.sqlgen import fold_of
from tabloom.jobs.planning import rules_sql, summary_sql
from tabloom.jobs.preparation import split_cte
from tabloom.operators.metrics import rank_trials
from tabloom.operators.pipeline import FittedPipeline, TabularPipeline, cross_validate, summarize_cv
from tabloom.operators.profile import Brief, profile_dataset
from tabloom.operators.split import assign_folds, holdout_split
from tabloom.plans import catalog as cat
from tabloom.plans.feature_plan import build_feature_plan
from tabloom.plans.workflow import competition_dashboard, execute_workflow, pick_best
from tabloom.session import checkpoint_dir, cut_lineage
from tabloom.sources.io import read_run

R4 = 4  # model outputs: decimals kept in compared results

_RIDGE_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _ridge_setup(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(*_RIDGE_COLS)
    brief = Brief("ridge", "l_extendedprice", "regression")
    profile, _ = profile_dataset(li, brief, key_cols=["l_orderkey", "l_linenumber"])
    plan = build_feature_plan(profile, "minimal_cleanup", {"drop_features": ["l_orderkey", "l_linenumber"]})
    split = cut_lineage(holdout_split(li, ["l_orderkey", "l_linenumber"]))
    pipe = TabularPipeline(plan, "regression", "ridge_regression", "l_extendedprice",
                           ["l_orderkey", "l_linenumber"], {"alpha": 1.0}, cat.default_training_configuration("ridge_regression", profile.rows))
    return split, pipe


_RIDGE_SQL = "WITH " + split_cte("lineitem", ["l_orderkey", "l_linenumber"], ties=_RIDGE_COLS) + """,
tr AS (SELECT * FROM sp WHERE split = 'train'),
fit AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1.0) AS b,
               avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM tr),
m AS (SELECT b, my - b * mx AS b0 FROM fit)"""


@job("ridge_coefficients", _RIDGE_SQL + f"\nSELECT round(b, {R4}) AS coef_l_quantity, round(b0, {R4}) AS intercept FROM m")
def ridge_coefficients(spark, sf_dir):
    """M2: ridge (alpha 1, unpenalised intercept) solved from one moments aggregate."""
    split, pipe = _ridge_setup(spark, sf_dir)
    fitted = pipe.fit(split.where("split = 'train'"))
    lm = fitted.linear
    return spark.createDataFrame([(round(lm.coef[0], R4), round(lm.intercept, R4))], "coef_l_quantity double, intercept double")


@job("ridge_holdout_metrics", _RIDGE_SQL + f""",
p AS (SELECT l_extendedprice AS actual, b0 + b * l_quantity AS prediction FROM sp, m WHERE split = 'test')
SELECT round(sqrt(avg((actual - prediction) ^ 2)), {R4}) AS rmse, round(avg(abs(actual - prediction)), {R4}) AS mae,
       round(1 - sum((actual - prediction) ^ 2) / (var_pop(actual) * count(*)), {R4}) AS r2 FROM p""")
def ridge_holdout_metrics(spark, sf_dir):
    """M2 + A4-A6 on the holdout."""
    from tabloom.operators.pipeline import score
    split, pipe = _ridge_setup(spark, sf_dir)
    fitted = pipe.fit(split.where("split = 'train'"))
    m = score(fitted, split.where("split = 'test'"), pipe.key_cols)
    return spark.createDataFrame([(round(m["rmse"], R4), round(m["mae"], R4), round(m["r2"], R4))],
                                 "rmse double, mae double, r2 double")


_ALPHAS = cat.search_space("ridge_regression", "expanded_competition")["alpha"]
_CV_TIE = ", ".join(["l_orderkey", "l_linenumber", *sorted(_RIDGE_COLS)])
_GRID_SQL = "WITH " + split_cte("lineitem", ["l_orderkey", "l_linenumber"], ties=_RIDGE_COLS) + f""",
tr AS (SELECT l_quantity AS x, l_extendedprice AS y,
              {fold_of(f"(row_number() OVER (ORDER BY {sql_row_hash(['l_orderkey', 'l_linenumber'], 'fold:42')}, {_CV_TIE}) - 1)", "(SELECT count(*) FROM sp WHERE split = 'train')", 5)} AS fold
       FROM sp WHERE split = 'train'),
a AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({a!r} AS DOUBLE))' for i, a in enumerate(_ALPHAS))}) AS t(trial, alpha)),
f AS (SELECT DISTINCT fold FROM tr),
fit AS (SELECT f.fold, a.trial, a.alpha,
               covar_pop(tr.x, tr.y) * count(*) / (var_pop(tr.x) * count(*) + a.alpha) AS b,
               avg(tr.y) AS my, avg(tr.x) AS mx
        FROM f JOIN tr ON tr.fold <> f.fold CROSS JOIN a GROUP BY f.fold, a.trial, a.alpha),
sc AS (SELECT fit.trial, fit.alpha, fit.fold,
              sqrt(avg((tr.y - (fit.my - fit.b * fit.mx + fit.b * tr.x)) ^ 2)) AS rmse
       FROM fit JOIN tr ON tr.fold = fit.fold GROUP BY fit.trial, fit.alpha, fit.fold),
d AS (SELECT trial, alpha, avg(rmse) AS cv_metric, stddev_pop(rmse) AS cv_metric_std FROM sc GROUP BY trial, alpha)"""


def _dashboard(spark, sf_dir):
    split, pipe = _ridge_setup(spark, sf_dir)
    train = split.where("split = 'train'").drop("split")
    folded = cut_lineage(assign_folds(train, pipe.key_cols, 5))
    grid = cat.expand_grid(cat.search_space("ridge_regression", "expanded_competition"))
    rows = cross_validate(pipe, folded, 5, grid=grid)
    summary = summarize_cv(rows, "regression")
    dash = competition_dashboard(spark, [{"trial": t, "params": grid[t], "cv_metric": summary[t]["rmse"],
                                          "cv_metric_std": summary[t]["rmse_std"]} for t in range(len(grid))], "rmse")
    return dash, grid


@job("competition_rank", _GRID_SQL + f"""
SELECT CAST(trial AS BIGINT) AS trial, alpha, round(cv_metric, {R4}) AS cv_metric, round(cv_metric_std, {R4}) AS cv_metric_std,
       CAST(rank() OVER (ORDER BY round(cv_metric, 9)) AS BIGINT) AS rank FROM d""")
def competition_rank(spark, sf_dir):
    """H1, H5, H6, H8: ridge alpha grid (expanded width), 5-fold CV inside train, trials ranked."""
    dash, grid = _dashboard(spark, sf_dir)
    alphas = F.create_map(*[x for t, g in enumerate(grid) for x in (F.lit(t), F.lit(float(g["alpha"])))])
    rounded = dash.withColumn("cv_metric", F.round("cv_metric", 9))
    return rank_trials(rounded.drop("rank"), "rmse").select(
        "trial", F.element_at(alphas, F.col("trial").cast("int")).alias("alpha"),
        F.round("cv_metric", R4).alias("cv_metric"), F.round("cv_metric_std", R4).alias("cv_metric_std"), "rank")


@job("pick_best", _GRID_SQL + f"""
SELECT alpha AS best_alpha, round(cv_metric, {R4}) AS best_cv_metric, CAST((SELECT count(*) FROM d) AS BIGINT) AS trials_tested
FROM d ORDER BY round(cv_metric, 9), trial LIMIT 1""")
def pick_best_job(spark, sf_dir):
    """The best trial by cross-validated rmse (lower wins; ties -> grid order)."""
    dash, grid = _dashboard(spark, sf_dir)
    alphas = F.create_map(*[x for t, g in enumerate(grid) for x in (F.lit(t), F.lit(float(g["alpha"])))])
    results = dash.select("trial", F.round("cv_metric", 9).alias("cv_value"), F.lit(None).cast("double").alias("test_value"))
    best = pick_best(results, "rmse", order_col="trial")
    return best.select(F.element_at(alphas, F.col("trial").cast("int")).alias("best_alpha"),
                       F.round("cv_value", R4).alias("best_cv_metric"),
                       F.lit(len(grid)).cast("bigint").alias("trials_tested"))


# ---- Spark ML models (rows-only) --------------------------------------------------------------

def _docs_pipeline(spark, sf_dir, model: str, extra_params=None):
    df = fx.labelled_documents(spark, sf_dir).drop("text")
    brief = Brief("docs", "quality", "classification")
    profile, _ = profile_dataset(df, brief, key_cols=["doc_id"])
    plan = build_feature_plan(profile, "auto_tabular_preprocessing", {"drop_features": ["doc_id"]})
    params = cat.default_model_parameters(model, profile.rows, profile.class_imbalance)
    params.update(extra_params or {})
    training = cat.default_training_configuration(model, profile.rows)
    split = cut_lineage(holdout_split(df, ["doc_id"], "stratified_holdout", target="quality", task_type="classification"))
    pipe = TabularPipeline(plan, "classification", model, "quality", ["doc_id"], params, training)
    fitted = pipe.fit(split.where("split = 'train'"))
    return fitted.predict(split.where("split = 'test'"), ["doc_id", "quality"])


@job("logistic_holdout")
def logistic_holdout(spark, sf_dir):
    """M1 (+ M9 balanced weights when imbalanced): predictions for the stratified holdout."""
    return _docs_pipeline(spark, sf_dir, "logistic_regression")


@job("forest_holdout")
def forest_holdout(spark, sf_dir):
    """M3: random forest classifier (sqrt features) on the stratified holdout."""
    return _docs_pipeline(spark, sf_dir, "random_forest_classifier")


@job("boosting_holdout")
def boosting_holdout(spark, sf_dir):
    """M5: gradient boosting with early stopping on a hashed 10% validation slice."""
    return _docs_pipeline(spark, sf_dir, "hist_gradient_boosting_classifier")


@job("mlp_holdout")
def mlp_holdout(spark, sf_dir):
    """M7: multilayer perceptron classifier (64, 32)."""
    return _docs_pipeline(spark, sf_dir, "mlp_classifier")


def _supplier_pipeline(spark, sf_dir, model: str):
    df = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    brief = Brief("suppliers", "s_acctbal", "regression")
    profile, _ = profile_dataset(df, brief, key_cols=["s_suppkey"])
    plan = build_feature_plan(profile, "auto_tabular_preprocessing", {"drop_features": ["s_suppkey"]})
    params = cat.default_model_parameters(model, profile.rows, None)
    training = cat.default_training_configuration(model, profile.rows)
    split = cut_lineage(holdout_split(df, ["s_suppkey"]))
    pipe = TabularPipeline(plan, "regression", model, "s_acctbal", ["s_suppkey"], params, training)
    fitted = pipe.fit(split.where("split = 'train'"))
    return fitted.predict(split.where("split = 'test'"), ["s_suppkey", "s_acctbal"])


@job("forest_regressor_holdout")
def forest_regressor_holdout(spark, sf_dir):
    """M4: random forest regressor (all features per split)."""
    return _supplier_pipeline(spark, sf_dir, "random_forest_regressor")


@job("boosting_regressor_holdout")
def boosting_regressor_holdout(spark, sf_dir):
    """M6: gradient boosting regressor with early stopping."""
    return _supplier_pipeline(spark, sf_dir, "hist_gradient_boosting_regressor")


@job("mlp_regressor_holdout")
def mlp_regressor_holdout(spark, sf_dir):
    """M8: data-parallel MLP regressor (per-partition gradients, Adam on the driver)."""
    return _supplier_pipeline(spark, sf_dir, "mlp_regressor")


# ---- workflow (rows-only) ------------------------------------------------------------------

FLAGSHIP_BRIEF = Brief("lineitem price", "l_extendedprice", "regression", date_column="l_shipdate")


def _flagship(spark, sf_dir, output_root=None):
    li = fx.table(spark, sf_dir, "lineitem")
    return execute_workflow(
        spark, FLAGSHIP_BRIEF, li, ["l_orderkey", "l_linenumber"],
        selected={"03_model_selection": "ridge_regression", "01_preprocessing": "auto_tabular_preprocessing"},
        preprocessing_overrides={"drop_features": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]},
        output_root=output_root)


def flagship_leaderboard(spark, sf_dir):
    """W6 + H13: time-ordered holdout on ship date, ridge vs the mean baseline."""
    res = _flagship(spark, sf_dir)
    return res.leaderboard.select("model", "role", "split", "metric", F.round("value", R4).alias("value"))


job("leaderboard")(flagship_leaderboard)


@job("run_artifacts")
def run_artifacts(spark, sf_dir):
    """The run's tables written under the shared checkpoint folder, read back."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/artifacts"
    res = _flagship(spark, sf_dir, output_root=root)
    return read_run(spark, root, res.run_id)["leaderboard"].withColumn("run_id", F.lit(res.run_id))


@job("score_saved_model")
def score_saved_model(spark, sf_dir):
    """S9 + W8: a fitted pipeline saved, loaded back and used to score the holdout."""
    split, pipe = _ridge_setup(spark, sf_dir)
    fitted = pipe.fit(split.where("split = 'train'"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/ridge"
    fitted.save(path)
    loaded = FittedPipeline.load(spark, path)
    return loaded.predict(split.where("split = 'test'"), ["l_orderkey", "l_linenumber", "l_extendedprice"])


_PREVIEW_SQL = _RIDGE_SQL + f"""
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, round(b0 + b * l_quantity, {R4}) AS prediction
FROM sp, m WHERE split = 'test'
ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 25"""


@job("prediction_preview", _PREVIEW_SQL)
def prediction_preview_job(spark, sf_dir):
    """The first 25 holdout predictions in key order (a top-k report)."""
    from tabloom.sources.io import prediction_preview
    split, pipe = _ridge_setup(spark, sf_dir)
    fitted = pipe.fit(split.where("split = 'train'"))
    scored = fitted.predict(split.where("split = 'test'"), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    prev = prediction_preview(scored, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_quantity"], 25)
    return prev.select("l_orderkey", "l_linenumber", "actual", F.round("prediction", R4).alias("prediction"))


@job("actual_vs_predicted_histogram", _RIDGE_SQL + """,
p AS (SELECT l_extendedprice AS actual, b0 + b * l_quantity AS prediction FROM sp, m WHERE split = 'test')
SELECT CAST(least(greatest(floor((actual - 0.0) / 2500.0), 0), 39) AS INTEGER) AS actual_bin,
       CAST(least(greatest(floor((prediction - 0.0) / 2500.0), 0), 39) AS INTEGER) AS predicted_bin,
       count(*) AS n FROM p GROUP BY ALL""")
def actual_vs_predicted_histogram(spark, sf_dir):
    """A14 at scale: every holdout point binned into a 40 x 40 grid (0 to 100,000)."""
    from tabloom.operators.metrics import prediction_histogram
    split, pipe = _ridge_setup(spark, sf_dir)
    fitted = pipe.fit(split.where("split = 'train'"))
    scored = fitted.predict(split.where("split = 'test'"), ["l_extendedprice"])
    return prediction_histogram(scored.withColumnRenamed("l_extendedprice", "actual"), 0.0, 100_000.0, 40)


# ---- run record, one-feature leaderboard, rules that a model must find ---------------------------

_LINEITEM = ("lineitem", FLAGSHIP_BRIEF, "l_orderkey", ["l_shipdate"], ["l_returnflag", "l_linestatus"], [],
             ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])


@job("run_decisions", "WITH " + summary_sql(0, _LINEITEM, "lineitem") + rules_sql(1, """
SELECT step_id, step_number, title, selected_option AS recommended,
       CASE step_id WHEN '03_model_selection' THEN 'ridge_regression' WHEN '01_preprocessing' THEN 'auto_tabular_preprocessing' ELSE selected_option END AS selected FROM steps"""))
def run_decisions(spark, sf_dir):
    """Recommended and selected option per step, read back from the committed run."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/artifacts"
    res = _flagship(spark, sf_dir, output_root=root)
    return read_run(spark, root, res.run_id)["decisions"]


_ONE_SQL = _RIDGE_SQL + f""",
base AS (SELECT avg(l_extendedprice) AS c FROM tr),
te AS (SELECT l_extendedprice AS y, b0 + b * l_quantity AS p, c FROM sp, m, base WHERE split = 'test'),
tf AS (SELECT l_quantity AS x, l_extendedprice AS y,
              {fold_of(f"(row_number() OVER (ORDER BY {sql_row_hash(['l_orderkey', 'l_linenumber'], 'fold:42')}, {_CV_TIE}) - 1)", "(SELECT count(*) FROM tr)", 5)} AS fold FROM tr),
ff AS (SELECT f.fold, covar_pop(tf.x, tf.y) * count(*) / (var_pop(tf.x) * count(*) + 1.0) AS b, avg(tf.y) AS my, avg(tf.x) AS mx
       FROM (SELECT DISTINCT fold FROM tf) f JOIN tf ON tf.fold <> f.fold GROUP BY f.fold),
pf AS (SELECT tf.fold, y, my + b * (x - mx) AS p FROM tf JOIN ff USING (fold)),
sf AS (SELECT sqrt(avg((y - p) ^ 2)) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM pf GROUP BY fold),
long AS (
  SELECT 'mean_value' AS model, 'baseline' AS role, 'test' AS split, sqrt(avg((y - c) ^ 2)) AS rmse, avg(abs(y - c)) AS mae, 1 - sum((y - c) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM te
  UNION ALL SELECT 'ridge_regression', 'candidate', 'test', sqrt(avg((y - p) ^ 2)), avg(abs(y - p)), 1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)) FROM te, (VALUES (1), (2))
     AS twice(k) GROUP BY k
  UNION ALL SELECT 'ridge_regression', 'candidate', 'cv', avg(rmse), avg(mae), avg(r2) FROM sf, (VALUES (1), (2)) AS twice(k) GROUP BY k)
SELECT model, role, split, metric, round(value, {R4}) AS value FROM long UNPIVOT (value FOR metric IN (rmse, mae, r2))"""


@job("leaderboard_one_feature", _ONE_SQL)
def leaderboard_one_feature(spark, sf_dir):
    """W6 + H13 with a closed form: the whole workflow on one feature, ridge against the mean (initial and final model are the same)."""
    li = fx.table(spark, sf_dir, "lineitem").select(*_RIDGE_COLS)
    res = execute_workflow(spark, Brief("one feature", "l_extendedprice", "regression"), li, ["l_orderkey", "l_linenumber"],
                           selected={"03_model_selection": "ridge_regression", "01_preprocessing": "minimal_cleanup", "05_metric_selection": "rmse",
                                     "02_data_splitting": "random_holdout", "06_training_configuration": "thorough_training"},
                           preprocessing_overrides={"drop_features": ["l_orderkey", "l_linenumber"]})
    return res.leaderboard.select("model", "role", "split", "metric", F.round("value", R4).alias("value"))


@job("saved_model_predictions", _RIDGE_SQL + f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, round(b0 + b * l_quantity, {R4}) AS prediction FROM sp, m WHERE split = 'test'""")
def saved_model_predictions(spark, sf_dir):
    """S9 + W8 with a closed form: every holdout row scored by the pipeline that was saved and loaded."""
    return score_saved_model(spark, sf_dir).withColumn("prediction", F.round("prediction", R4))


_RULE_COLS = ["o_orderkey", "f1", "f2", "y"]
_PARTS = "CASE WHEN o_orderkey % 16 < 5 THEN 'a' WHEN o_custkey % 8 < 3 THEN 'b' ELSE 'c' END"
_HALVES = "CASE WHEN o_orderkey % 16 + 2 * (o_custkey % 8) > 14 THEN 'over' ELSE 'under' END"
_STEPS = "10.0 * CAST(o_orderkey % 16 < 5 AS INTEGER) + 3.0 * CAST(o_custkey % 8 >= 3 AS INTEGER)"
_LINE = "0.5 * (o_orderkey % 16) - (o_custkey % 8)"


def _rule_sql(rule: str) -> str:
    """The holdout rows with the rule's value, which is what the model must predict."""
    kind = "DOUBLE" if rule in (_STEPS, _LINE) else "VARCHAR"
    return (f"WITH src AS (SELECT o_orderkey, o_orderkey % 16 AS f1, o_custkey % 8 AS f2, CAST({rule} AS {kind}) AS y FROM orders), " + split_cte("src", ["o_orderkey"], ties=_RULE_COLS)
            + " SELECT o_orderkey, y AS prediction FROM sp WHERE split = 'test'")


def _rule_holdout(spark, sf_dir, rule: str, model: str, params: dict, training: dict):
    """Fit on rows whose target is a rule of two features, predict the others."""
    numeric = rule in (_STEPS, _LINE)
    df = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 16).alias("f1"), (F.col("o_custkey") % 8).alias("f2"),
                                                  F.expr(rule).cast("double" if numeric else "string").alias("y"))
    task = "regression" if numeric else "classification"
    profile, _ = profile_dataset(df, Brief("rule", "y", task), key_cols=["o_orderkey"])
    plan = build_feature_plan(profile, "auto_tabular_preprocessing", {"drop_features": ["o_orderkey"]})
    split = cut_lineage(holdout_split(df, ["o_orderkey"]))
    settings = cat.default_training_configuration(model, profile.rows) | training
    fitted = TabularPipeline(plan, task, model, "y", ["o_orderkey"], cat.default_model_parameters(model, profile.rows, None) | params, settings).fit(split.where("split = 'train'"))
    return fitted.predict(split.where("split = 'test'"), ["o_orderkey"])


@job("forest_rule", _rule_sql(_PARTS))
def forest_rule(spark, sf_dir):
    """M3: trees grown until pure give back a rule of three classes exactly."""
    return _rule_holdout(spark, sf_dir, _PARTS, "random_forest_classifier", {"n_estimators": 15, "min_samples_leaf": 1, "max_depth": None}, {})


@job("boosting_rule", _rule_sql(_PARTS))
def boosting_rule(spark, sf_dir):
    """M5: boosting of three classes gives back the rule exactly."""
    return _rule_holdout(spark, sf_dir, _PARTS, "hist_gradient_boosting_classifier", {"max_leaf_nodes": 15}, {"epochs": 10, "learning_rate": 0.3, "early_stopping": False})


@job("logistic_rule", _rule_sql(_HALVES))
def logistic_rule(spark, sf_dir):
    """M1: classes on the two sides of a line are told apart exactly."""
    return _rule_holdout(spark, sf_dir, _HALVES, "logistic_regression", {"C": 1000.0}, {"epochs": 500})


@job("mlp_rule", _rule_sql(_HALVES))
def mlp_rule(spark, sf_dir):
    """M7: a network does so too."""
    return _rule_holdout(spark, sf_dir, _HALVES, "mlp_classifier", {"hidden_layer_sizes": (8,), "alpha": 1e-6}, {"optimizer": "lbfgs", "epochs": 120, "early_stopping": False})


@job("forest_steps", _rule_sql(_STEPS))
def forest_steps(spark, sf_dir):
    """M4: a step function of two features, exactly."""
    out = _rule_holdout(spark, sf_dir, _STEPS, "random_forest_regressor", {"n_estimators": 10, "min_samples_leaf": 1, "max_depth": None}, {})
    return out.withColumn("prediction", F.round("prediction", 6))


@job("boosting_steps", _rule_sql(_STEPS))
def boosting_steps(spark, sf_dir):
    """M6: a step function of two features, by four leaves a round at full learning rate."""
    out = _rule_holdout(spark, sf_dir, _STEPS, "hist_gradient_boosting_regressor", {"max_leaf_nodes": 4}, {"epochs": 3, "learning_rate": 1.0, "early_stopping": False})
    return out.withColumn("prediction", F.round("prediction", 6))


@job("mlp_line", _rule_sql(_LINE))
def mlp_line(spark, sf_dir):
    """M8: a linear target, to the nearest half."""
    out = _rule_holdout(spark, sf_dir, _LINE, "mlp_regressor", {"hidden_layer_sizes": (8,), "alpha": 1e-6}, {"optimizer": "lbfgs", "epochs": 120, "early_stopping": False})
    return out.withColumn("prediction", F.round(F.col("prediction") * 2) / 2)
