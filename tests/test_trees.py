"""Histogram trees against plain NumPy: best-first growth, gains and leaf values with l2, losses, limits of forests,
and the same trees however rows are dealt and passes are made."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import trees as T


def frame(spark, x, y, w=None, valid=None, parts=3):
    rows = [(Vectors.dense(r), float(t), 1.0 if w is None else float(w[k]), bool(valid[k]) if valid is not None else False) for k, (r, t) in enumerate(zip(x, y))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("valid", BooleanType())])
    return spark.createDataFrame(rows, schema).repartition(parts, "label")


def data(n=600, seed=0, classes=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    f = 2 * (x[:, 0] > 0.3) - x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n) * 0.3
    y = f if not classes else np.digitize(f, np.quantile(f, np.arange(1, classes) / classes)).astype(float)
    return x, y


def boost_here(x, y, rate, rounds, leaves, depth, l2):
    """Squared-loss boosting, best leaf first, from all thresholds."""
    f, out = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        g = f - y
        parts, done = [(np.arange(len(y)), 0)], []

        def best(rows, d):
            top = None
            if depth is not None and d >= depth:
                return None
            for j in range(x.shape[1]):
                for t in np.unique(x[rows, j])[:-1]:
                    a = x[rows, j] <= t
                    nl, nr = a.sum(), (~a).sum()
                    if min(nl, nr) < T.MIN_LEAF:
                        continue
                    gl, gr = g[rows[a]].sum(), g[rows[~a]].sum()
                    gain = gl ** 2 / (nl + l2) + gr ** 2 / (nr + l2) - (gl + gr) ** 2 / (nl + nr + l2)
                    if gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                        top = (gain, rows[a], rows[~a], d + 1)
            return top

        found = [best(*p) for p in parts]
        while len(parts) < leaves and any(found):
            k = max((i for i in range(len(parts)) if found[i]), key=lambda i: found[i][0])
            _, a, b, d = found[k]
            parts[k:k + 1], found[k:k + 1] = [(a, d), (b, d)], [best(a, d), best(b, d)]
        for rows, _ in parts:
            f[rows] -= rate * g[rows].sum() / (len(rows) + l2)
        out.append(len(parts))
    return f, out


@pytest.mark.parametrize("leaves,depth,l2", [(6, None, 0.0), (31, 3, 5.0), (4, 2, 1.0)])
def test_boosting_equals_plain_best_first(spark, leaves, depth, l2):
    x, y = data()
    want, sizes = boost_here(x, y, 0.3, 3, leaves, depth, l2)
    got = T.fit(frame(spark, x, y), "hist_gradient_boosting_regressor", {"max_leaf_nodes": leaves, "max_depth": depth, "l2_regularization": l2},
                {"learning_rate": 0.3, "epochs": 3}, 0)
    assert [sum(f < 0 for f in t.feature) for t in got.trees] == sizes
    assert np.allclose(got.predicted(x), want, atol=1e-6)


def test_classifiers_early_stopping_and_same_trees_however_dealt(spark, monkeypatch):
    x, y = data(900, 1, 3)
    valid = np.arange(len(y)) % 10 == 0
    settings = {"learning_rate": 0.4, "epochs": 14, "early_stopping": True}
    one = T.fit(frame(spark, x, y, valid=valid), "hist_gradient_boosting_classifier", {"max_leaf_nodes": 8}, settings, 3)
    assert len(one.trees) == 3 * one.rounds
    flat, falling = [1.0] * (T.PATIENCE + 1), [1.0 - k / 99 for k in range(40)]
    assert T._no_gain(flat) and not T._no_gain(flat[1:]) and not T._no_gain(falling) and T._no_gain(falling + [falling[-1]] * T.PATIENCE)
    hidden, truth = data(500, 2, 3)
    assert (one.predicted(hidden) == truth).mean() > 0.75
    short = settings | {"epochs": 4}
    first = T.fit(frame(spark, x, y, valid=valid), "hist_gradient_boosting_classifier", {"max_leaf_nodes": 8}, short, 3)
    monkeypatch.setattr(T, "REFRESH", 3)
    monkeypatch.setattr(T, "BLOCK_ROWS", 100)
    other = T.fit(frame(spark, x, y, valid=valid, parts=7), "hist_gradient_boosting_classifier", {"max_leaf_nodes": 8}, short, 3)
    assert first.rows() == other.rows() == one.rows()[:12]
    scored = one.transform(frame(spark, x, y).select(F.col("label").alias("odd name"), "features"))
    assert scored.columns == ["odd name", "prediction"] and scored.where("prediction = `odd name`").count() == (one.predicted(x) == y).sum()
    binary = T.fit(frame(spark, x, np.minimum(y, 1)), "hist_gradient_boosting_classifier", {"max_leaf_nodes": 8}, {"epochs": 8, "learning_rate": 0.8}, 2)
    assert (binary.predicted(x) == np.minimum(y, 1)).mean() > 0.85


def depth_of(tree):
    best, stack = 0, [(0, 0)]
    while stack:
        k, d = stack.pop()
        best = max(best, d)
        if tree.feature[k] >= 0:
            stack += [(tree.left[k], d + 1), (tree.right[k], d + 1)]
    return best


def test_forest_limits_and_passes(spark, monkeypatch):
    x, y = data(700, 4, 3)
    fit = lambda parts=3, **p: T.fit(frame(spark, x, y, parts=parts), "random_forest_classifier", {"n_estimators": 12, **p}, {"random_seed": 7}, 3)
    whole = fit()
    assert (whole.predicted(x) == y).mean() > 0.95  # grown until pure
    assert max(map(depth_of, fit(max_depth=3).trees)) == 3 and max(map(depth_of, whole.trees)) > 6
    small, split = fit(min_samples_leaf=25), fit(min_samples_split=60)
    for t in small.trees:
        leaves = np.bincount(t.leaf_of(x), minlength=len(t.feature))[np.array(t.feature) < 0]
        assert len(leaves) <= 700 / 12
    nodes = lambda m: sum(len(t.feature) for t in m.trees)
    assert nodes(small) < nodes(whole) and nodes(split) < nodes(whole)
    monkeypatch.setattr(T, "LOCAL_ROWS", 40)  # most splits by passes
    monkeypatch.setattr(T, "WAVE_TREES", 5)
    passed = fit()
    hidden, truth = data(400, 5, 3)
    assert len(passed.trees) == 12 and nodes(passed) > 12 and (passed.predicted(hidden) == truth).mean() > 0.7
    assert [t.feature[0] for t in passed.trees] == [t.feature[0] for t in whole.trees]  # the same splits, found by another way
    assert nodes(passed) == nodes(whole) and np.array_equal(passed.raw(hidden), whole.raw(hidden))


def test_forest_regressor_and_weights(spark):
    x, y = data(500, 6)
    model = T.fit(frame(spark, x, y), "random_forest_regressor", {"n_estimators": 15}, {}, 0)
    hidden, truth = data(300, 7)
    assert 1 - ((model.predicted(hidden) - truth) ** 2).sum() / ((truth - truth.mean()) ** 2).sum() > 0.6
    label = (y > np.quantile(y, 0.9)).astype(float)
    flat = T.fit(frame(spark, x, label), "random_forest_classifier", {"n_estimators": 10, "max_depth": 2}, {}, 2)
    heavy = T.fit(frame(spark, x, label, w=np.where(label > 0, 9.0, 1.0)), "random_forest_classifier", {"n_estimators": 10, "max_depth": 2}, {}, 2)
    assert heavy.predicted(x).sum() > flat.predicted(x).sum()
    assert T.tries_of(None, 10, "sqrt") == 3 and T.tries_of(0.5, 10, "sqrt") == 5 and T.tries_of("log2", 8, "all") == 3 and T.tries_of(None, 7, "all") == 7


def test_predictions_by_groups_of_trees(spark, monkeypatch):
    """no task holds a forest whole."""
    x, y = data(300, 8, 3)
    model = T.fit(frame(spark, x, y), "random_forest_classifier", {"n_estimators": 6}, {}, 3)
    assert all(t.value.itemsize == 8 and t.feature.itemsize == 4 for t in model.trees) and len(model.groups()) == 1
    rows = frame(spark, x, y).select(F.col("label").alias("odd name"), "features")
    whole = sorted(map(tuple, model.transform(rows).collect()))
    monkeypatch.setattr(T, "GROUP_BYTES", 2 * max(t.size() for t in model.trees))
    groups = model.groups()
    assert len(groups) > 1 and sum(len(t) for _, t in groups) == 6 and all(sum(t.size() for t in g) <= T.GROUP_BYTES for _, g in groups)
    assert sorted(map(tuple, model.transform(rows).collect())) == whole


def test_boosting_looks_at_equal_rows_once(spark, monkeypatch):
    """a pass costs what the different rows cost, and the trees stay the same."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (900, 2)).astype(float)
    y = ((x[:, 0] > 1) ^ (rng.random(900) < 0.2)).astype(float)
    valid = np.arange(900) % 9 == 0
    args = "hist_gradient_boosting_classifier", {"max_leaf_nodes": 5}, {"epochs": 3, "learning_rate": 0.5}, 2
    counted = T._counted
    seen = []
    monkeypatch.setattr(T, "_counted", lambda blocks, width: seen.append(counted(blocks, width)) or seen[-1])
    once = T.fit(frame(spark, x, y, valid=valid), *args)
    blocks = [T._Block(r.asDict(), 2) for r in seen[0].collect()]
    assert sum(b.n for b in blocks) <= 4 * 4 * 2 * 2 and sum(int(b.m.sum()) for b in blocks) == 900
    monkeypatch.setattr(T, "_counted", lambda blocks, width: blocks)
    monkeypatch.setattr(T, "_rescored", None)
    assert T.fit(frame(spark, x, y, valid=valid), *args).rows() == once.rows()


def test_passes_of_a_regression_stop_at_pure_nodes(spark, monkeypatch):
    """a node whose rows have one target is not split further by passes."""
    rng = np.random.default_rng(10)
    x = rng.integers(0, 8, (800, 2)).astype(float)
    y = 10.0 * (x[:, 0] > 3)
    monkeypatch.setattr(T, "LOCAL_ROWS", 20)
    passes = []
    one = T._forest_pass
    monkeypatch.setattr(T, "_forest_pass", lambda *a: passes.append(1) or one(*a))
    model = T.fit(frame(spark, x, y), "random_forest_regressor", {"n_estimators": 2}, {}, 0)
    assert len(passes) == 2 and all(len(t.feature) == 3 for t in model.trees) and np.allclose(model.predicted(x), y, atol=1e-6)


def test_boosting_of_small_nodes_takes_one_job_a_round(spark, monkeypatch):
    """a round of a table with few different rows is one job, and gives the trees that passes give."""
    x, y = data(900, 11, 3)
    valid = np.arange(len(y)) % 10 == 0
    args = "hist_gradient_boosting_classifier", {"max_leaf_nodes": 9}, {"epochs": 3, "learning_rate": 0.4, "early_stopping": True}, 3
    jobs = {"passes": 0, "subtrees": 0}
    splits, subtrees = T._best_splits, T._best_subtrees
    monkeypatch.setattr(T, "_best_splits", lambda *a: jobs.update(passes=jobs["passes"] + 1) or splits(*a))
    monkeypatch.setattr(T, "_best_subtrees", lambda *a: jobs.update(subtrees=jobs["subtrees"] + 1) or subtrees(*a))
    one = T.fit(frame(spark, x, y, valid=valid), *args)
    assert jobs == {"passes": 0, "subtrees": 3}
    monkeypatch.setattr(T, "LOCAL_ROWS", 100)  # the upper nodes by passes
    some = T.fit(frame(spark, x, y, valid=valid), *args)
    assert jobs["passes"] > 0 and jobs["subtrees"] > 3
    monkeypatch.setattr(T, "LOCAL_ROWS", 0)
    assert one.rows() == some.rows() == T.fit(frame(spark, x, y, valid=valid), *args).rows()
