"""Preparation + model as one fitted unit (M10, M11, S9), cross-validation (A8) and
grid search (H7).

Cross-validation fits one preparation per fold, like the reference's cloned
pipeline, but all k of them come from shared passes (``FeaturePreparer.fit_folds``).
Callers materialise the split and folds once (``session.cut_lineage``), so folds and
refits never recompute them. Ridge regression stays exact with sufficient
statistics: every fold's moments come from one job, every alpha is solved on the
driver, and one pass scores every row with its own fold's model for all alphas.
Other models fit per (fold, trial), submitted from a few driver threads.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.operators import models as M
from tabloom.operators import networks as N
from tabloom.operators import trees as T
from tabloom.operators.metrics import HIGHER_IS_BETTER, METRICS
from tabloom.operators.preparer import FeaturePreparer, PreparedFeatures
from tabloom.plans.catalog import check_search_parameters, effective_parameters
from tabloom.plans.feature_plan import FeaturePlan

MAX_CLASSES = 1_000


@dataclass
class FittedPipeline:
    task_type: str
    model_name: str
    target: str
    prepared: PreparedFeatures
    labels: list = field(default_factory=list)
    linear: M.LinearModel | None = None
    network: N.Network | None = None
    trees: T.TreeModel | None = None
    spark_model: Any = None
    params: dict = field(default_factory=dict)
    training: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns (raw values) + ``prediction`` (labels in their own type)."""
        pk = "__keep__"
        back = [F.col(f"`{pk}{k}`").alias(k) for k in keep]
        if self.linear is not None:
            prep = self.prepared.transform(df, keep, pk)
            return prep.select(*back, self.linear.predict().alias("prediction"))
        assembled = self.prepared.assemble(df, keep, keep_prefix=pk)
        out = (self.trees or self.network or self.spark_model).transform(assembled)
        pred = F.col("prediction")
        if self.task_type == "classification":
            arr = F.array(*[F.lit(v) for v in self.labels])
            pred = F.element_at(arr, F.col("prediction").cast("int") + 1)
        return out.select(*back, pred.alias("prediction"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.prepared.save(f"{path}/prepared")
        meta = {"task_type": self.task_type, "model_name": self.model_name, "target": self.target,
                "labels": self.labels, "params": self.params, "training": self.training,
                "linear": None if self.linear is None else self.linear.__dict__,
                "network": None if self.network is None else self.network.__dict__,
                "trees": None if self.trees is None else {k: v for k, v in self.trees.__dict__.items() if k != "trees"},
                "spark_class": None if self.spark_model is None else
                f"{type(self.spark_model).__module__}.{type(self.spark_model).__name__}"}
        spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/meta")
        if self.trees is not None:
            spark.createDataFrame(self.trees.rows(), self.trees.ROW).write.mode("overwrite").parquet(f"{path}/trees")
        if self.spark_model is not None:
            self.spark_model.write().overwrite().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPipeline":
        import importlib
        meta = json.loads(spark.read.parquet(f"{path}/meta").collect()[0]["meta"])
        prepared = PreparedFeatures.load(spark, f"{path}/prepared")
        fp = FittedPipeline(meta["task_type"], meta["model_name"], meta["target"], prepared, meta["labels"],
                            params=meta["params"], training=meta["training"])
        if meta["linear"]:
            fp.linear = M.LinearModel(**meta["linear"])
        if meta["network"]:
            fp.network = N.Network(**meta["network"])
        if meta["trees"]:
            rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
            fp.trees = T.TreeModel(trees=[T.Tree(r["feature"], r["threshold"], r["left"], r["right"], r["value"]) for r in rows], **meta["trees"])
        if meta["spark_class"]:
            mod, cls = meta["spark_class"].rsplit(".", 1)
            fp.spark_model = getattr(importlib.import_module(mod), cls).load(f"{path}/model")
        return fp


@dataclass
class TabularPipeline:
    """Unfitted preparation plan + model choice."""
    plan: FeaturePlan
    task_type: str
    model_name: str
    target: str
    key_cols: list[str]
    params: dict = field(default_factory=dict)
    training: dict = field(default_factory=dict)

    def with_params(self, **params) -> "TabularPipeline":
        p, t = dict(self.params), dict(self.training)
        for k, v in params.items():
            # grid keys that move training settings override the configuration per trial
            if k in ("optimizer", "learning_rate", "epochs", "mini_batch"):
                t[k] = v
            else:
                p[k] = v
        return TabularPipeline(self.plan, self.task_type, self.model_name, self.target, self.key_cols, p, t)

    def fit(self, train: DataFrame, prepared: PreparedFeatures | None = None) -> FittedPipeline:
        prepared = prepared or FeaturePreparer(self.plan).fit(train)
        fp = FittedPipeline(self.task_type, self.model_name, self.target, prepared,
                            params=self.params, training=self.training)
        names = prepared.output_names()
        if self.model_name == "ridge_regression":
            prep = prepared.transform(train, [self.target])
            fp.linear = M.fit_ridge(prep, names, self.target, float(self.params.get("alpha", 1.0)))
            return fp
        keep = [self.target, *self.key_cols]
        data = prepared.assemble(train, keep, keep_prefix="__keep__")
        data = data.select(*[F.col(f"`__keep__{k}`").alias(k) for k in keep], "features")
        n_classes = None
        if self.task_type == "classification":
            labels = sorted({r[0] for r in train.select(F.col(f"`{self.target}`")).distinct().limit(MAX_CLASSES + 1).collect()}, key=lambda v: (v is None, v))
            if len(labels) > MAX_CLASSES:
                raise ValueError(f"there are more classes than {MAX_CLASSES}")
            if any(v is None for v in labels):
                raise ValueError(f"target {self.target!r} has missing labels in the training rows")
            fp.labels = labels
            n_classes = len(labels)
            idx = None
            for i, v in enumerate(labels):
                cond = F.col(self.target) == F.lit(v)
                idx = F.when(cond, F.lit(float(i))) if idx is None else idx.when(cond, F.lit(float(i)))
            data = data.withColumn("label", idx)
        else:
            data = data.withColumn("label", F.col(self.target).cast("double"))
        weighted = self.params.get("class_weight") in ("balanced", "balanced_subsample") and self.task_type == "classification"
        if weighted:
            data = data.withColumn("weight", M.weight_column(M.balanced_weights(data, "label")))
        if self.model_name != "logistic_regression":
            valid = F.lit(False)
            if self.training.get("early_stopping") and not self.model_name.startswith("random_forest"):
                valid = unit_hash(self.key_cols, "valid:42") < F.lit(float(self.training.get("validation_fraction", 0.1)))
            rows = data.select("features", "label", (F.col("weight") if weighted else F.lit(1.0)).alias("weight"), valid.alias("valid"))
            if not self.model_name.startswith("mlp_"):
                fp.trees = T.fit(rows, self.model_name, self.params, self.training, n_classes or 0)
                return fp
            t = self.training
            fp.network = N.fit(rows, self.params.get("hidden_layer_sizes", (64, 32)), n_classes or 0, alpha=float(self.params.get("alpha", 1e-4)),
                               optimizer=t.get("optimizer") or "adam", rate=float(t.get("learning_rate") or 1e-3), epochs=int(t.get("epochs") or 250),
                               batch=int(t.get("mini_batch") or 200), seed=int(t.get("random_seed", 42)), early_stopping=bool(t.get("early_stopping")))
            return fp
        fp.spark_model = M.logistic(self.params, self.training, data.count(), weighted).fit(data)
        return fp


def score(fitted: FittedPipeline, df: DataFrame, key_cols: list[str]) -> dict[str, float]:
    from tabloom.operators.metrics import evaluate
    pred = fitted.predict(df, [*key_cols, fitted.target])
    return evaluate(pred.select(F.col(fitted.target).alias("actual"), "prediction"), fitted.task_type)


def cross_validate(pipe: TabularPipeline, folded: DataFrame, k: int, fold_col: str = "fold",
                   grid: list[dict] | None = None, parallelism: int = 4) -> list[dict]:
    """Per trial (grid entry) and fold: the metrics of the model fitted on the other
    folds. Returns rows ``{trial, fold, <metrics>}``. All k preparations come from
    shared passes (``FeaturePreparer.fit_folds``)."""
    grid = grid or [{}]
    preps = FeaturePreparer(pipe.plan).fit_folds(folded, k, fold_col)
    for trial in grid:
        check_search_parameters(pipe.model_name, trial)
    if pipe.model_name == "ridge_regression" and all(len(p.output_names()) <= M.WIDE for p in preps) and not any(p.freq_maps or p.joined() or p.level_tables for p in preps):
        return _ridge_cv(pipe, folded, k, fold_col, grid, preps)  # one expression scores all folds and alphas
    # trials that fit the same model are fitted once
    keys = [effective_parameters(pipe.model_name, q.params, q.training) for q in (pipe.with_params(**trial) for trial in grid)]
    first = {key: t for t, key in reversed(list(enumerate(keys)))}
    # independent (fold, trial) fits: submitted from a few driver threads so their
    # Spark jobs share the cluster, like CrossValidator(parallelism=...)
    from concurrent.futures import ThreadPoolExecutor

    def one(ft):
        f, t = ft
        tr, va = folded.where(F.col(fold_col) != f), folded.where(F.col(fold_col) == f)
        fitted = pipe.with_params(**grid[t]).fit(tr, prepared=preps[f])
        return {"trial": t, "fold": f, **score(fitted, va, pipe.key_cols)}

    tasks = [(f, t) for f in range(k) for t in sorted(first.values())]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(tasks)))) as pool:
        fitted = {(r["fold"], r["trial"]): r for r in pool.map(one, tasks)}
    return [fitted[f, first[keys[t]]] | {"trial": t} for f in range(k) for t in range(len(grid))]


def _ridge_cv(pipe: TabularPipeline, folded: DataFrame, k: int, fold_col: str, grid: list[dict],
              preps: list[PreparedFeatures]) -> list[dict]:
    """Ridge CV for every alpha of the grid: per fold the sufficient statistics
    of its prepared training rows (all alphas solved from them), then a
    single pass that scores every row, for every alpha, with the model of the fold
    it validates (scalar CASE-by-fold expressions, kept inside codegen)."""
    from tabloom.operators.preparer import _pre_frame
    alphas = [float({**pipe.params, **g}.get("alpha", 1.0)) for g in grid]
    target = pipe.target
    fold = F.col(fold_col)
    pre = _pre_frame(pipe.plan, folded, {}, {}, keep=[fold_col, target])
    models = {}
    exprs = [prep.output_expressions() for prep in preps]
    moms = _fold_moments(pre, preps, fold_col, target)
    if moms is None:  # the folds' features differ in kind: one branch per fold, all in one job
        moms = M.moments([(f, pre.where(fold != f).select(*exprs[f], F.col(target)), preps[f].output_names())
                          for f in range(k)], target)
    for f in range(k):
        for t, a in enumerate(alphas):
            coef, b0 = M.ridge_solve(moms[f], a)
            models[(t, f)] = ([float(c) for c in coef], float(b0))
    width = max(len(e) for e in exprs)
    xcols = []
    for j in range(width):
        e = None
        for f in range(k):
            v = exprs[f][j] if j < len(exprs[f]) else F.lit(0.0)
            e = F.when(fold == f, v) if e is None else e.when(fold == f, v)
        xcols.append(e.cast("double").alias(f"_x{j}"))
    scored = pre.select(fold.alias("_f"), F.col(target).cast("double").alias("_y"), *xcols)
    aggs = [F.count(F.lit(1)).alias("n"), F.var_pop("_y").alias("vy")]
    for t in range(len(alphas)):
        pred = None
        for f in range(k):
            coef, b0 = models[(t, f)]
            lin = F.lit(b0)
            for j, c in enumerate(coef):
                lin = lin + F.col(f"_x{j}") * F.lit(c)
            pred = F.when(F.col("_f") == f, lin) if pred is None else pred.when(F.col("_f") == f, lin)
        e = F.col("_y") - pred
        aggs += [F.sum(e * e).alias(f"sse{t}"), F.sum(F.abs(e)).alias(f"sae{t}")]
    res = {r["_f"]: r for r in scored.groupBy("_f").agg(*aggs).collect()}
    rows = []
    for f in range(k):
        r = res[f]
        sst = (r["vy"] or 0.0) * r["n"]
        for t in range(len(alphas)):
            sse = r[f"sse{t}"]
            r2 = 1 - sse / sst if sst > 0 else (1.0 if sse == 0 else 0.0)
            rows.append({"trial": t, "fold": f, "rmse": (sse / r["n"]) ** 0.5, "mae": r[f"sae{t}"] / r["n"], "r2": r2})
    return rows


def _fold_moments(pre: DataFrame, preps: list[PreparedFeatures], fold_col: str, target: str) -> dict[int, dict] | None:
    """Per fold the moments of the other folds' rows as its own preparation makes them, with each row read for its own
    fold only. The preparations differ in centre, scale and fill of numeric features, so each one's features are linear in those of
    the first and in marks of missing values. None if they differ in more: in levels, or in which features have a fill."""
    first, names = preps[0], preps[0].output_names()
    numeric = [c for c in names if c in first.plan.numeric_features]
    for p in preps[1:]:
        if p.output_names() != names or p.categories != first.categories or p.fills.keys() != first.fills.keys():
            return None
        if any(p.fills[c] != v for c, v in first.fills.items() if c not in numeric):
            return None
    marked = [c for c in numeric if any(p.fills.get(c) != first.fills.get(c) for p in preps)]
    basis = [e.alias(f"b{i}") for i, e in enumerate(first.output_expressions())]
    basis += [F.col(f"`{c}`").isNull().cast("double").alias(f"b{len(names) + i}") for i, c in enumerate(marked)]
    width = len(basis)
    frame = pre.select(F.col(f"`{fold_col}`").alias("_group"), *basis, F.col(f"`{target}`").alias("_label"))
    groups = M.group_moments(frame, "_group", [f"b{i}" for i in range(width)], "_label")
    out = {}
    for f, p in enumerate(preps):
        weights, constants = np.zeros((len(names) + 1, width + 1)), np.zeros(len(names) + 1)
        weights[-1, -1] = 1.0
        for j, c in enumerate(names):
            weights[j, j] = 1.0
            if c in numeric:
                (center, scale), (own, by) = first.scalers.get(c, (0.0, 1.0)), p.scalers.get(c, (0.0, 1.0))
                weights[j, j], constants[j] = scale / by, (center - own) / by
                if c in marked:
                    weights[j, len(names) + marked.index(c)] = (p.fills[c] - first.fills[c]) / by
        out[f] = M.mapped(M.pooled([m for g, m in groups.items() if g != f]), weights, constants)
    return out


def summarize_cv(rows: list[dict], task_type: str) -> dict[int, dict[str, float]]:
    """Mean over folds per trial (plus population std of each metric)."""
    out: dict[int, dict[str, float]] = {}
    for t in sorted({r["trial"] for r in rows}):
        rs = [r for r in rows if r["trial"] == t]
        d = {}
        for m in METRICS[task_type]:
            vals = np.array([r[m] for r in rs], dtype=float)
            d[m] = float(vals.mean())
            d[f"{m}_std"] = float(vals.std())
        out[t] = d
    return out


def grid_search(pipe: TabularPipeline, folded: DataFrame, k: int, grid: list[dict], metric: str,
                refit_on: DataFrame) -> tuple[FittedPipeline, list[dict]]:
    """H7: every trial over the folds on the selected metric; the best (first in
    grid order on ties) is refitted on all training rows. Returns the dashboard rows."""
    rows = cross_validate(pipe, folded, k, grid=grid)
    summary = summarize_cv(rows, pipe.task_type)
    higher = HIGHER_IS_BETTER[metric]
    best = None
    for t in range(len(grid)):
        v = summary[t][metric]
        if best is None or (v > summary[best][metric] if higher else v < summary[best][metric]):
            best = t
    dashboard = [{"trial": t, "params": grid[t], "cv_metric": summary[t][metric],
                  "cv_metric_std": summary[t][f"{metric}_std"]} for t in range(len(grid))]
    fitted = pipe.with_params(**grid[best]).fit(refit_on)
    return fitted, dashboard
