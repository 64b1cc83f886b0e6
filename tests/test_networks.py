"""Networks and ridge against plain NumPy; parameters that move a fit and those that are refused."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabloom.operators import networks as N
from tabloom.operators.models import fit_ridge, moments
from tabloom.plans import catalog as cat


def frame(spark, x, y, valid=None):
    rows = [(Vectors.dense(r), float(t), bool(valid[k]) if valid is not None else False) for k, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "valid"]).repartition(3)


def problem(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, np.abs(x[:, 0]) * 2 - x[:, 1] + 0.1 * rng.normal(size=n)


def test_gradient_is_right():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3))
    for classes, y in ((0, rng.normal(size=20)), (2, rng.integers(0, 2, 20).astype(float)), (4, rng.integers(0, 4, 20).astype(float))):
        p = N._Problem([3, 5, 4, 1 if classes <= 2 else classes], classes, 0.1)
        w = p.start(3)
        _, grad = p.loss(w, x, y)
        for k in rng.integers(0, len(w), 12):
            e = np.zeros(len(w))
            e[k] = 1e-6
            assert grad[k] == pytest.approx((p.loss(w + e, x, y)[0] - p.loss(w - e, x, y)[0]) / 2e-6, rel=1e-4, abs=1e-5)


def test_epoch_equals_plain_mini_batches(spark):
    x, y = problem(100)
    net = N.fit(frame(spark, x, y), (4,), 0, alpha=0.01, rate=0.01, epochs=3, batch=32, seed=5)
    order = np.lexsort((*x.T[::-1], y))
    xs, ys = x[order], y[order]
    p = N._Problem([3, 4, 1], 0, 0.01)
    w = p.start(5)
    m = v = np.zeros(len(w))
    t = 0
    for epoch in range(3):
        seen = np.random.Generator(np.random.Philox(key=np.array([5, epoch << 40], np.uint64))).permutation(100)
        for k in range(0, 100, 32):
            rows = seen[k:k + 32]
            g = (p.loss(w, xs[rows], ys[rows])[1] + 0.01 * p.penalized(w)) / len(rows)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m / (np.sqrt(v) + 1e-8)
    got = np.concatenate([np.concatenate([np.ravel(a), b]) for a, b in net.weights])
    assert np.allclose(got, w, atol=1e-10)


def test_optimizers_learn(spark, monkeypatch):
    x, y = problem()
    hidden, truth = problem(300, 9)
    r2 = lambda net: 1 - ((net.predicted(hidden) - truth) ** 2).sum() / ((truth - truth.mean()) ** 2).sum()
    assert r2(N.fit(frame(spark, x, y), (16, 8), 0, optimizer="lbfgs", epochs=60)) > 0.9
    valid = np.arange(len(y)) % 10 == 0
    stopped = N.fit(frame(spark, x, y, valid), (16, 8), 0, rate=0.02, epochs=150, early_stopping=True)
    assert stopped.epochs < 150 and r2(stopped) > 0.8
    monkeypatch.setattr(N, "BLOCK_ROWS", 120)  # several blocks: local updates, averaged
    assert r2(N.fit(frame(spark, x, y), (16, 8), 0, optimizer="sgd", rate=0.01, epochs=25)) > 0.8
    label = np.digitize(y, [0.0, 1.5]).astype(float)
    net = N.fit(frame(spark, x, label), (16,), 3, optimizer="lbfgs", epochs=40)
    assert (net.predicted(x) == label).mean() > 0.9
    with pytest.raises(ValueError, match="not valid"):
        N.fit(frame(spark, x, y), (4,), 0, optimizer="newton")


def test_ridge_at_every_width_and_far_from_zero(spark):
    rng = np.random.default_rng(2)
    year = 2000 + rng.integers(0, 20, 300) + 0.0
    key = 10.0 ** 9 + rng.integers(0, 1000, 300)
    x = np.column_stack([year, key, rng.normal(size=(300, 70))])
    y = 3 * (year - 2010) + 0.01 * (key - 10 ** 9) + x[:, 2] + rng.normal(size=300) * 0.01 + 5e6
    names = [f"c{k}" for k in range(72)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y double").repartition(4)
    xc, yc = x - x.mean(0), y - y.mean()
    for cols in (names, names[:3]):
        p = len(cols)
        want = np.linalg.solve(xc[:, :p].T @ xc[:, :p] + 0.5 * np.eye(p), xc[:, :p].T @ yc)
        got = fit_ridge(df, cols, "y", 0.5)
        assert np.allclose(got.coef, want, rtol=1e-9, atol=1e-9)
        out = df.select("y", got.predict().alias("p")).toPandas()
        assert abs((out["p"] - out["y"]).mean()) < 1e-6
    several = moments([("a", df, names[:2]), ("b", df.where("c0 > 2010"), names[:3])], "y")
    assert several["a"]["n"] == 300 and several["b"]["xx"].shape == (4, 4)


def test_equal_trials_have_equal_keys():
    key = lambda model, params, **training: cat.effective_parameters(model, params, cat.default_training_configuration(model, 100) | training)
    assert key("logistic_regression", {"C": 1.0}, optimizer="saga") == key("logistic_regression", {"C": 1.0}, optimizer="lbfgs")
    assert key("mlp_regressor", {}, optimizer="lbfgs", mini_batch=16) == key("mlp_regressor", {}, optimizer="lbfgs", mini_batch=64)
    assert key("mlp_regressor", {}, mini_batch=16) != key("mlp_regressor", {}, mini_batch=64)
    for model in ("random_forest_classifier", "hist_gradient_boosting_regressor", "ridge_regression", "mlp_classifier"):
        for trial in cat.expand_grid(cat.search_space(model, "small_competition")):
            cat.check_search_parameters(model, trial)
    with pytest.raises(ValueError, match="can't be searched"):
        cat.check_search_parameters("ridge_regression", {"C": 1.0})
