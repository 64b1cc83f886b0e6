"""Fitted transforms and baselines on the reference's numeric cases."""

from __future__ import annotations

import pytest

from tabloom.operators.baseline import baseline_prediction, choose_baseline_strategy
from tabloom.operators.preparer import FeaturePreparer
from tabloom.operators.profile import Brief, profile_dataset
from tabloom.plans.feature_plan import build_feature_plan


def test_mean_impute_then_minmax(spark):
    df = spark.createDataFrame([(10.0, 0), (None, 1), (30.0, 0)], "age double, target int")
    p, _ = profile_dataset(df, Brief("m", "target", "classification"))
    plan = build_feature_plan(p, "custom", {"feature_imputation_rules": [{"feature": "age", "strategy": "mean"}],
                                            "feature_scaling_rules": [{"feature": "age", "method": "minmax"}]})
    out = [r["age"] for r in FeaturePreparer(plan).fit(df).transform(df).collect()]
    assert out == pytest.approx([0.0, 0.5, 1.0])


def test_log1p_and_frequency_counts(spark):
    df = spark.createDataFrame([(9.0, "north", 0), (99.0, "south", 1), (999.0, "north", 0), (99.0, "south", 1)],
                               "monthly_spend double, region string, target int")
    p, _ = profile_dataset(df, Brief("f", "target", "classification"))
    plan = build_feature_plan(p, "minimal_cleanup", {
        "feature_transform_rules": [{"feature": "monthly_spend", "kind": "log1p"}],
        "derived_feature_rules": [{"kind": "frequency_count", "source": "region"}]})
    rows = FeaturePreparer(plan).fit(df).transform(df, keep=[]).collect()
    import math
    assert sorted(r["monthly_spend"] for r in rows)[0] == pytest.approx(math.log1p(9.0))
    assert [r["region__frequency_count"] for r in rows] == [2.0, 2.0, 2.0, 2.0]


def test_standard_scale_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (10.0, 1)], "x double, target int")
    p, _ = profile_dataset(df, Brief("s", "target", "classification"))
    plan = build_feature_plan(p, "auto_tabular_preprocessing")
    import numpy as np
    xs = np.array([1.0, 2.0, 3.0, 10.0])
    want = (xs - xs.mean()) / xs.std()
    got = sorted(r["x"] for r in FeaturePreparer(plan).fit(df).transform(df).collect())
    assert got == pytest.approx(sorted(want))


def test_median_imputation_is_exact(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (10.0, 1), (None, 0)], "x double, target int")
    p, _ = profile_dataset(df, Brief("s", "target", "classification"))
    plan = build_feature_plan(p, "minimal_cleanup")
    out = FeaturePreparer(plan).fit(df)
    assert out.fills["x"] == 2.5


def test_unseen_category_zeros_and_minus_one(spark):
    train = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "c1 string, c2 string, target int")
    test = spark.createDataFrame([("z", "q", 0)], "c1 string, c2 string, target int")
    p, _ = profile_dataset(train, Brief("u", "target", "classification"))
    plan = build_feature_plan(p, "minimal_cleanup", {"force_ordinal_features": ["c2"]})
    row = FeaturePreparer(plan).fit(train).transform(test).collect()[0].asDict()
    assert row["c1=a"] == 0.0 and row["c1=b"] == 0.0 and row["c2"] == -1.0


def test_classification_baseline_choice_and_priors(spark):
    assert choose_baseline_strategy("classification", "f1_macro") == "stratified_random"
    assert choose_baseline_strategy("regression", "rmse") == "mean_value"
    assert choose_baseline_strategy("regression", "mae") == "median_value"
    df = spark.createDataFrame([(i, 1 + i, int(i >= 3)) for i in range(6)], "k int, x1 int, target int")
    pred = baseline_prediction(df, "target", "classification", "stratified_random", ["k"])
    labels = {r[0] for r in df.select(pred).collect()}
    assert labels <= {0, 1}
    mf = baseline_prediction(df, "target", "classification", "most_frequent", ["k"])
    assert df.select(mf).first()[0] == 0  # tie 3/3 -> smallest label


def test_regression_baselines(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 12, 13, 15, 100, 120])], "k int, y double")
    assert df.select(baseline_prediction(df, "y", "regression", "mean_value", ["k"])).first()[0] == pytest.approx(45.0)
    assert df.select(baseline_prediction(df, "y", "regression", "median_value", ["k"])).first()[0] == pytest.approx(14.0)


def test_fold_aware_fit_equals_per_fold_fits(spark):
    from tabloom.operators.split import assign_folds
    rows = [(i, None if i % 7 == 0 else float((i * 13) % 50), ["a", "b", "c", None][i % 4], float(i % 9), i % 2)
            for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, c string, z double, target int")
    p, _ = profile_dataset(df, Brief("f", "target", "classification"), key_cols=["k"])
    plan = build_feature_plan(p, "auto_tabular_preprocessing", {
        "drop_features": ["k"], "feature_scaling_rules": [{"feature": "z", "method": "robust"}]})
    folded = assign_folds(df, ["k"], 4)
    shared = FeaturePreparer(plan).fit_folds(folded, 4)
    for f in range(4):
        single = FeaturePreparer(plan).fit(folded.where(f"fold != {f}"))
        assert shared[f].categories == single.categories
        assert shared[f].fills.keys() == single.fills.keys()
        for c in single.fills:
            assert shared[f].fills[c] == pytest.approx(single.fills[c])
        for c in single.scalers:
            assert shared[f].scalers[c] == pytest.approx(single.scalers[c])


def test_assembled_one_hot_equals_transformed_columns(spark):
    from decimal import Decimal
    rows = [(i, f"v{i % 40}", Decimal(i % 50) / 4, (i % 50) / 8, i % 3 == 0, i % 9, float(i % 7), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, c string, d decimal(10,2), e double, b boolean, n int, x double, target int")
    p, _ = profile_dataset(df, Brief("w", "target", "classification"), key_cols=["k"])
    plan = build_feature_plan(p, "auto_tabular_preprocessing", {"drop_features": ["k"], "force_one_hot_features": ["d", "e", "b", "n"]})
    prep = FeaturePreparer(plan).fit(df.where("k < 300"))
    unseen = [(999, "unseen", Decimal("99.5"), 99.5, None, 77, 1.0, 0)]
    test = df.union(spark.createDataFrame(unseen, df.schema))
    assembled = {r["k"]: r["features"].toArray().tolist() for r in prep.assemble(test, ["k"]).collect()}
    columns = {r["__k"]: [r[n] for n in prep.output_names()] for r in prep.transform(test, ["k"], keep_prefix="__").collect()}
    assert assembled.keys() == columns.keys()
    for k in columns:
        assert assembled[k] == pytest.approx(columns[k])
        assert sum(columns[k][1:]) == (5 if k != 999 else 0)  # one level of each of the five features


def test_null_level_and_text_null_keep_apart(spark):
    df = spark.createDataFrame([(i, ["null", None, "a"][i % 3], float(i), i % 2) for i in range(30)], "k long, c string, x double, target int")
    p, _ = profile_dataset(df, Brief("w", "target", "classification"), key_cols=["k"])
    plan = build_feature_plan(p, "minimal_cleanup", {"drop_features": ["k"]})
    plan.imputation.clear()
    prep = FeaturePreparer(plan).fit(df)
    assert len(set(prep.output_names())) == len(prep.output_names()) == 4
    assert prep.assemble(df, ["k"]).count() == 30
