"""Recommendation rules (R1-R13) as one Spark job over a table of profile summaries.

``profile_summary`` turns a brief and its profile into one row (bounded); a catalog
of (table, target) pairs, or the segments of one large table, becomes a summary
table keyed by ``dataset_id``. ``recommend`` then evaluates every rule as a
``CASE WHEN`` column and emits the nine workflow steps per dataset with a Generate
(no join), so planning any number of datasets is a single projection.
"""

from __future__ import annotations

from collections.abc import Callable
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import Brief, Profile
from tabloom.plans import catalog as cat

SUMMARY_SCHEMA = (
    "dataset_id string, task_type string, date_column string, baseline_metric string, "
    "competition_enabled boolean, rows bigint, n_categorical bigint, n_identifier bigint, "
    "n_date_like bigint, n_constant bigint, n_high_card bigint, missing_fraction double, "
    "class_imbalance double, target_skew double"
)


def profile_summary(dataset_id: str, brief: Brief, profile: Profile) -> tuple:
    return (dataset_id, brief.task_type, brief.date_column, brief.baseline_metric, bool(brief.competition_enabled),
            profile.rows, len(profile.categorical_features), len(profile.likely_identifier_features),
            len(profile.date_like_features), len(profile.constant_features),
            len(profile.high_cardinality_categorical_features), float(profile.missing_fraction),
            profile.class_imbalance, profile.target_skew)


def profile_catalog(spark: SparkSession, datasets: list[tuple[str, Brief, DataFrame, list[str] | None]],
                    parallelism: int = 4) -> DataFrame:
    """Profile several (dataset_id, brief, frame, key columns) at once and return the
    summary table. Profiles are independent, so their jobs are submitted from a few
    driver threads and share the cluster (as ``CrossValidator(parallelism=...)`` does)."""
    from concurrent.futures import ThreadPoolExecutor

    from tabloom.operators.profile import profile_dataset

    def one(item):
        did, brief, df, keys = item
        profile, _ = profile_dataset(df, brief, key_cols=keys)
        return profile_summary(did, brief, profile)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(datasets)))) as pool:
        rows = list(pool.map(one, datasets))
    return summary_frame(spark, rows)


def summary_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def rule_columns() -> dict[str, Column]:
    cls = F.col("task_type") == "classification"
    skew_ok = F.col("target_skew").isNotNull() & ~F.isnan("target_skew") & (F.col("target_skew") != 0)
    big_skew = skew_ok & (F.abs("target_skew") >= cat.SKEW_LIMIT)
    flagged = (F.col("n_identifier") + F.col("n_date_like") + F.col("n_constant") + F.col("n_high_card")) > 0
    preprocessing = (F.when(flagged, "custom").when(F.col("missing_fraction") == 0, "minimal_cleanup")
                     .otherwise("auto_tabular_preprocessing"))  # R1
    split = (F.when(_given("date_column"), "time_ordered_holdout").when(cls, "stratified_holdout")
             .otherwise("random_holdout"))  # R2
    metric = (F.when(_given("baseline_metric"), F.col("baseline_metric"))
              .when(cls, F.when(F.coalesce(F.col("class_imbalance"), F.lit(0.0)) >= cat.IMBALANCE_LIMIT,
                                "balanced_accuracy").otherwise("f1_macro"))
              .otherwise(F.when(big_skew, "mae").otherwise("rmse")))  # R3
    no_cat_small = (F.col("n_categorical") == 0) & (F.col("rows") <= cat.LINEAR_MAX_ROWS)
    model = (F.when(cls, F.when(F.col("rows") >= cat.HGB_ROWS, "hist_gradient_boosting_classifier")
                    .when(no_cat_small, "logistic_regression")
                    .when((F.col("n_high_card") > 0) | (F.col("rows") >= cat.HGB_ROWS_CLASSIFICATION),
                          "hist_gradient_boosting_classifier")
                    .otherwise("random_forest_classifier"))
             .otherwise(F.when(F.col("rows") >= cat.HGB_ROWS, "hist_gradient_boosting_regressor")
                        .when(no_cat_small, "ridge_regression")
                        .when(big_skew, "hist_gradient_boosting_regressor")
                        .otherwise("random_forest_regressor")))  # R4
    training = F.when(F.col("rows") > cat.THOROUGH_ROWS, "thorough_training").otherwise("standard_training")  # R7
    hpo = F.when(F.col("competition_enabled"), "small_competition").otherwise("skip")  # R9
    return {"preprocessing": preprocessing, "split": split, "metric": metric, "model": model,
            "training": training, "hpo": hpo}


def recommend(summary: DataFrame) -> DataFrame:
    """Nine rows per dataset: ``dataset_id, step_id, step_number, title,
    selected_option, options`` (options comma-joined)."""
    r = rule_columns()
    cls = F.col("task_type") == "classification"
    models = F.when(cls, F.lit(",".join(cat.CLASSIFICATION_MODELS))).otherwise(F.lit(",".join(cat.REGRESSION_MODELS)))
    metrics = F.when(cls, F.lit(",".join(cat.METRIC_OPTIONS["classification"]))).otherwise(
        F.lit(",".join(cat.METRIC_OPTIONS["regression"])))
    chosen = {
        "00_intake": (F.lit("structured_brief"), None),
        "01_preprocessing": (r["preprocessing"], None),
        "02_data_splitting": (r["split"], None),
        "03_model_selection": (r["model"], models),
        "05_metric_selection": (r["metric"], metrics),
        "06_training_configuration": (r["training"], None),
        "08_validation_and_baseline": (F.lit("test_set_with_baseline"), None),
        "07_hyperparameter_optimization": (r["hpo"], None),
        "09_final_validation": (F.lit("final_validation_dashboard"), None),
    }
    steps = []
    for step_id, number, title in cat.STEPS:
        sel, opts = chosen[step_id]
        options = opts if opts is not None else F.lit(",".join(cat.STEP_OPTIONS[step_id]))
        steps.append(F.struct(F.lit(step_id).alias("step_id"), F.lit(number).cast("bigint").alias("step_number"),
                              F.lit(title).alias("title"), sel.alias("selected_option"), options.alias("options")))
    return summary.select("dataset_id", F.inline(F.array(*steps)))


def _setting(v) -> Column:
    """A default as text: depending on the number of rows where it does."""
    if isinstance(v, cat.BySize):
        return F.when(F.col("rows") <= v.limit, _setting(v.small)).otherwise(_setting(v.large))
    text = None if v is None else str(v).lower() if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    return F.lit(text).cast("string")


def _by_model(model: Column, of: Callable[[str], dict[str, Column]], name: str) -> Column:
    """An array of (name, value) for the row's model, whichever of all models it is."""
    out = F.lit(None)
    for m in (*cat.CLASSIFICATION_MODELS, *cat.REGRESSION_MODELS):
        rows = F.array(*[F.struct(F.lit(k).alias(name), v.alias("value")) for k, v in of(m).items()])
        out = F.when(model == m, rows).otherwise(out)
    return out


def recommended_parameters(summary: DataFrame) -> DataFrame:
    """R5 as rows (dataset_id, model, parameter, value): the recommended model's default parameters."""
    def of(m: str) -> dict[str, Column]:
        own = {k: _setting(v) for k, v in (cat.PARAMETERS.get(m) or cat.PARAMETERS[cat.FAMILY[m]]).items()}
        if m == "logistic_regression":
            own["class_weight"] = F.when(F.coalesce(F.col("class_imbalance"), F.lit(0.0)) >= cat.IMBALANCE_LIMIT, "balanced")
        return own
    model = rule_columns()["model"]
    return summary.select("dataset_id", model.alias("model"), F.inline(_by_model(model, of, "parameter")))


def recommended_training(summary: DataFrame) -> DataFrame:
    """R6 and R7 as rows (dataset_id, setting, value): training settings of the recommended model under the recommended budget."""
    r = rule_columns()

    def of(m: str) -> dict[str, Column]:
        settings = cat.TRAINING | cat.TRAINING_OF.get(cat.FAMILY[m], {})
        own = {k: _setting(v) for k, v in settings.items()}
        folds, factor, fewest = cat.BUDGETS["thorough"]
        thorough = r["training"] == "thorough_training"
        own["cv_folds"] = F.when(thorough, F.lit(str(folds))).otherwise(F.greatest(F.lit(3), own["cv_folds"].cast("int")).cast("string"))
        if settings["epochs"]:
            own["epochs"] = F.when(thorough, F.lit(str(max(fewest, int(settings["epochs"] * factor))))).otherwise(own["epochs"])
        return own
    return summary.select("dataset_id", F.inline(_by_model(r["model"], of, "setting")))


def recommendation_details(summary_row: dict) -> dict[str, str]:
    """Per-dataset metadata (R5, R6, R8, H5) from the selected options: bounded, driver-side."""
    from tabloom.operators.baseline import choose_baseline_strategy
    task, rows = summary_row["task_type"], summary_row["rows"]
    model, metric, hpo = summary_row["model"], summary_row["metric"], summary_row["hpo"]
    params = cat.default_model_parameters(model, rows, summary_row.get("class_imbalance"))
    training = cat.default_training_configuration(model, rows)
    space = {} if hpo == "skip" else {k: [str(v) for v in vals] for k, vals in cat.search_space(model, hpo).items()}
    return {
        "model_parameters": json.dumps(params, default=str),
        "training_config": json.dumps(training, default=str),
        "baseline_strategy": choose_baseline_strategy(task, metric),
        "search_parameters": json.dumps([] if hpo == "skip" else cat.default_search_parameters(model, hpo)),
        "search_space": json.dumps(space),
    }
