"""Models, search scope, and every registered job against its DuckDB oracle."""

from __future__ import annotations

import numpy as np
import pytest

from tabloom.plans import catalog as cat


def test_search_scope_and_grid():
    assert cat.search_scope("random_forest_classifier", "small_competition", ["max_depth", "class_weight", "bogus"]) \
        == ["max_depth", "class_weight"]
    space = cat.search_space("random_forest_classifier", "small_competition")
    assert len(cat.expand_grid(space)) == 48
    assert len(cat.expand_grid(cat.search_space("mlp_classifier", "expanded_competition"))) == 972
    assert cat.search_space("ridge_regression", "skip") == {"alpha": [0.1, 1.0, 10.0]}
    grid = cat.expand_grid({"b": [1, 2], "a": ["x", "y"]})
    assert grid[0] == {"a": "x", "b": 1} and grid[1] == {"a": "x", "b": 2}
    assert cat.top_parameters("hist_gradient_boosting_classifier", 2) == ["learning_rate", "max_depth"]
    with pytest.raises(ValueError, match="not supported"):
        cat.check_overrides("ridge_regression", {"C": 1.0})


def test_ridge_matches_closed_form(spark):
    from tabloom.operators.models import fit_ridge
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)], "a double, b double, c double, y double")
    m = fit_ridge(df, ["a", "b", "c"], "y", alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coef, coef, atol=1e-8)
    assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ coef)


def test_macro_f1_and_balanced_accuracy(spark):
    from tabloom.operators.metrics import evaluate
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, prediction string")
    m = evaluate(df, "classification")
    # per-class recall a=1/2, b=1, c=0 -> 0.5; f1: a=2/3, b=2/3*..., c=0
    assert m["accuracy"] == pytest.approx(0.5)
    assert m["balanced_accuracy"] == pytest.approx(0.5)
    f1_a = 2 * 1 / (2 * 1 + 0 + 1)
    f1_b = 2 * 1 / (2 * 1 + 2 + 0)
    assert m["f1_macro"] == pytest.approx((f1_a + f1_b + 0.0) / 3)


ORACLE_FAST = [
    "profile_feature_table", "profile_date_like", "split_random", "split_stratified", "split_time_ordered_text",
    "kfold_stratified", "impute_median", "scale_robust", "one_hot_wide", "encode_unseen", "frequency_count",
    "metrics_classification", "baseline_stratified_random", "cv_score_by_fold", "recommend_steps",
    "ridge_coefficients", "competition_rank",
]


@pytest.mark.parametrize("name", ORACLE_FAST)
def test_job_matches_oracle(spark, name):
    import sys
    from pathlib import Path
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tools.oracle_check import compare, duck
    sf = "/root/testdata/sf0.01"
    msg, ok = compare(spark, duck(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert {r["role"] for r in rows} == {"baseline", "candidate"}
    assert set(df.columns) == {"model", "role", "split", "metric", "value"}


def test_mlp_regressor_beats_mean_baseline(spark):
    from pyspark.sql import functions as F
    from tabloom.operators.pipeline import TabularPipeline, score
    from tabloom.operators.profile import Brief, profile_dataset
    from tabloom.operators.split import holdout_split
    from tabloom.plans.feature_plan import build_feature_plan
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        "o_orderkey", (F.col("o_custkey") % 97 / 10.0).alias("x1"), (F.col("o_orderkey") % 89 / 10.0).alias("x2"))
    o = o.withColumn("y", 3 * F.col("x1") - 2 * F.col("x2") * F.col("x2"))
    p, _ = profile_dataset(o, Brief("m", "y", "regression"), key_cols=["o_orderkey"])
    plan = build_feature_plan(p, "auto_tabular_preprocessing", {"drop_features": ["o_orderkey"]})
    s = holdout_split(o, ["o_orderkey"])
    training = cat.default_training_configuration("mlp_regressor", p.rows)
    training.update(learning_rate=0.01, epochs=120)
    fitted = TabularPipeline(plan, "regression", "mlp_regressor", "y", ["o_orderkey"],
                             {"hidden_layer_sizes": (16, 8), "alpha": 1e-4}, training).fit(s.where("split = 'train'"))
    assert score(fitted, s.where("split = 'test'"), ["o_orderkey"])["r2"] > 0.5


def test_scope_edits_and_top_trials(spark):
    from tabloom.plans.workflow import competition_dashboard, top_trials
    assert cat.edit_scope(["a", "b"], add=["c"], remove=["a"]) == ["b", "c"]
    assert cat.edit_scope(["a"], replace=["x", "x", "y"]) == ["x", "y"]
    rows = [{"trial": t, "params": {"alpha": t}, "cv_metric": float(20 - t % 7), "cv_metric_std": 0.0} for t in range(20)]
    dash = competition_dashboard(spark, rows, "rmse")
    top = top_trials(dash, 12).collect()
    assert len(top) == 12 and top[0]["rank"] == 1 and top[0]["cv_metric"] == 14.0
    assert [r["rank"] for r in top] == sorted(r["rank"] for r in top)


def test_folds_moments_read_each_row_once(spark, monkeypatch):
    """the moments of all folds' complements come from one frame, not from a branch per fold, and equal those of the branches,
    also where folds differ in fill, centre and scale."""
    import numpy as np
    from tabloom.operators import models as M
    from tabloom.operators import pipeline as P
    from tabloom.operators.preparer import FeaturePreparer, _pre_frame
    from tabloom.plans.feature_plan import FeaturePlan

    rng = np.random.default_rng(5)
    rows = [(k, k % 3, float(rng.normal(1e6, 3)) if k % 7 else None, float(k * k % 11), "ab"[k % 2], float(rng.normal())) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, fold int, u double, v double, c string, y double")
    plan = FeaturePlan("custom", (), (), ("u", "v"), (), ("c",), ("c",), (), ("u", "v"), ("c",), {},
                       {"u": {"strategy": "mean"}}, {"u": "standard", "v": "minmax"}, {"c": "one_hot"})
    preps = FeaturePreparer(plan).fit_folds(df, 3)
    assert len({p.fills["u"] for p in preps}) == 3
    pre = _pre_frame(plan, df, {}, {}, keep=["fold", "y"])
    want = M.moments([(f, pre.where(f"fold <> {f}").select(*preps[f].output_expressions(), "y"), preps[f].output_names()) for f in range(3)], "y")
    read = []
    plain = M._centred
    monkeypatch.setattr(M, "_centred", lambda frames, width: read.append(len(frames)) or plain(frames, width))
    got = P._fold_moments(pre, preps, "fold", "y")
    assert read == [1]
    for f in range(3):
        assert got[f]["n"] == want[f]["n"]
        np.testing.assert_allclose(got[f]["mean"], want[f]["mean"], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[f]["xx"], want[f]["xx"], rtol=1e-8, atol=1e-8)
