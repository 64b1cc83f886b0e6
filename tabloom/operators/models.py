"""Linear models (M1, M2) and class weights (M9). Trees are in ``trees``, networks in ``networks``.

* ridge regression (M2) is solved exactly from sufficient statistics, at every width. One aggregate gives the means; a second pass
  the products of the centred features and label, block by block as a matrix product, summed row by row of the matrix by
  Spark (grouped by fold when cross-validating). As the columns are centred before they are multiplied, years, keys and other
  columns far from zero lose no digits. ``(Xc'Xc + alpha I) b = Xc'yc`` is solved on the driver (a p x p system); every alpha
  of a grid and every fold comes from the same two passes.
* logistic regression is Spark ML's on the assembled vector, its penalty scaled by the rows being fitted, class
  weights as a weight column computed on the training rows only. All solvers reach the same optimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import ship

MAX_CLASSES = 1_000
WIDE = 64  # features from which a prediction is an array expression, not a sum of terms


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---- M2: ridge -----------------------------------------------------------------------

def moments(parts: list[tuple[Any, DataFrame, list[str]]], label: str) -> dict[Any, dict]:
    """Per part (key, frame, feature columns) the centred sufficient statistics: n, ``mean`` (features, then label) and ``xx``, the
    products of the centred features and label. Rows without a label do not count. Two passes over all parts together."""
    width = max(len(cols) for _, _, cols in parts)
    frames = []
    for k, (_, df, cols) in enumerate(parts):
        x = [_c(c).cast("double") for c in cols] + [F.lit(0.0)] * (width - len(cols)) + [_c(label).cast("double")]
        frames.append(df.where(_c(label).isNotNull()).select(F.lit(k).alias("key"), *[v.alias(f"x{i}") for i, v in enumerate(x)]))
    found = _centred(frames, width + 1)
    out = {}
    for k, (name, _, cols) in enumerate(parts):
        if k not in found:
            raise ValueError("there are no rows with a label to fit")
        n, mean, xx = found[k]
        keep = [*range(len(cols)), width]
        out[name] = {"n": n, "mean": mean[keep], "xx": xx[np.ix_(keep, keep)]}
    return out


def group_moments(df: DataFrame, group: str, cols: list[str], label: str) -> dict[int, dict]:
    """``moments`` of each group of the rows, by its number in the column ``group``: every row is read once a pass."""
    x = [_c(c).cast("double") for c in [*cols, label]]
    rows = df.where(_c(label).isNotNull()).select(_c(group).cast("int").alias("key"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    return {k: {"n": n, "mean": mean, "xx": xx} for k, (n, mean, xx) in _centred([rows], len(x)).items()}


def pooled(groups: list[dict]) -> dict:
    """The moments of several groups together."""
    if not groups:
        raise ValueError("there are no rows with a label to fit")
    n = sum(m["n"] for m in groups)
    mean = sum(m["n"] * m["mean"] for m in groups) / n
    return {"n": n, "mean": mean, "xx": sum(m["xx"] + m["n"] * np.outer(m["mean"] - mean, m["mean"] - mean) for m in groups)}


def mapped(m: dict, weights: np.ndarray, constants: np.ndarray) -> dict:
    """The moments of ``weights`` @ x + ``constants``."""
    return {"n": m["n"], "mean": weights @ m["mean"] + constants, "xx": weights @ m["xx"] @ weights.T}


def _centred(frames: list[DataFrame], width: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, means and centred products by key of the frames (key, x0, x1, ...). What is taken off before the products are
    made need not be the exact mean, as the rest of it is taken off after: an average rounded to 40 bits, the same in whichever
    order Spark adds it up."""
    names = [f"x{i}" for i in range(width)]
    rows = reduce(DataFrame.unionByName, [fr.select("key", F.array(*names).alias("x")) for fr in frames])
    ship(rows.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                key, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if (key == key[0]).all():
                    yield int(key[0]), x
                    continue
                order = np.argsort(key, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    yield int(key[part[0]]), x[part]

    def summed(products: DataFrame) -> dict[tuple[int, int], np.ndarray]:
        def add(group: pa.Table) -> pa.Table:
            x = np.sort(np.stack([np.asarray(v) for v in group["x"].to_pylist()]), 0).sum(0)  # in one order, however they come
            return pa.table({"key": group["key"].slice(0, 1), "row": group["row"].slice(0, 1), "x": pa.array([x.tolist()], pa.list_(pa.float64()))})
        return {(r["key"], r["row"]): np.asarray(r["x"]) for r in products.groupBy("key", "row").applyInArrow(add, "key int, row int, x array<double>").toArrow().to_pylist()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, x in blocks(batches):
            total[k] = total.get(k, 0) + np.append(x.sum(0), len(x))
        yield _matrix_rows(total)

    if width > WIDE:  # too many for one aggregate
        means = {k: v[:-1] / v[-1] for (k, _), v in summed(rows.mapInArrow(sums, "key int, row int, x array<double>")).items()}
    else:
        near = [fr.groupBy("key").agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).alias("x")) for fr in frames]
        means = {r["key"]: _rounded(np.asarray(r["x"])) for r in reduce(DataFrame.unionByName, near).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(means)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, x in blocks(batches):
            z = np.column_stack([x - shared.value[k], np.ones(len(x))])
            total[k] = total.get(k, 0) + z.T @ z
        yield _matrix_rows(total)

    got = summed(rows.mapInArrow(products, "key int, row int, x array<double>"))
    out = {}
    for k, mean in means.items():
        z = np.stack([got[k, i] for i in range(width + 1)])
        n, rest = z[-1, -1], z[-1, :-1]
        out[k] = (int(n), mean + rest / n, z[:-1, :-1] - np.outer(rest, rest) / n)  # what rounding left of the means goes
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    part, power = np.frexp(x)
    return np.ldexp(np.round(part * 2.0 ** 40) / 2.0 ** 40, power)


def _matrix_rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows (key, row, x) of the matrices of each key."""
    rows = [(k, i, line.tolist()) for k, m in total.items() for i, line in enumerate(np.atleast_2d(m))]
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, kinds)], ["key", "row", "x"])


def ridge_solve(m: dict, alpha: float) -> tuple[np.ndarray, float]:
    xx, p = m["xx"], len(m["mean"]) - 1
    coef = np.linalg.solve(xx[:p, :p] + alpha * np.eye(p), xx[:p, p]) if p else np.zeros(0)
    return coef, float(m["mean"][p] - m["mean"][:p] @ coef)


@dataclass
class LinearModel:
    cols: list[str]
    coef: list[float]
    intercept: float

    def predict(self) -> Column:
        if len(self.cols) > WIDE:
            terms = F.zip_with(F.array(*[_c(c).cast("double") for c in self.cols]), F.array(*[F.lit(float(w)) for w in self.coef]), lambda x, w: x * w)
            return F.aggregate(terms, F.lit(float(self.intercept)), lambda a, x: a + x)
        expr = F.lit(self.intercept)
        for c, w in zip(self.cols, self.coef):
            expr = expr + _c(c).cast("double") * F.lit(float(w))
        return expr


def fit_ridge(df: DataFrame, cols: list[str], label: str, alpha: float = 1.0) -> LinearModel:
    coef, b0 = ridge_solve(moments([(None, df, cols)], label)[None], alpha)
    return LinearModel(list(cols), [float(v) for v in coef], b0)


# ---- class weights (M9) -----------------------------------------------------------------

def balanced_weights(train: DataFrame, label: str) -> dict:
    """n / (k * n_c) from the training rows (at most MAX_CLASSES classes)."""
    rows = train.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"there are more classes than {MAX_CLASSES}")
    n, k = sum(r[1] for r in rows), len(rows)
    return {r[0]: n / (k * r[1]) for r in rows}


def weight_column(weights: dict) -> Column:
    """The weight of the row's ``label``, an index of classes: one look-up in an array."""
    if not weights:
        return F.lit(1.0)
    by_class = [float(weights.get(float(k), 1.0)) for k in range(int(max(weights)) + 1)]
    return F.coalesce(F.get(F.array(*[F.lit(w) for w in by_class]), F.col("label").cast("int")), F.lit(1.0))


def logistic(params: dict, training: dict, n_rows: int, weighted: bool):
    """M1: the unfitted estimator; ``n_rows`` is the sum of the weights of the rows that it will be fitted on."""
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (float(params.get("C", 1.0)) * n_rows), elasticNetParam=0.0,
                              standardization=False, maxIter=int(training.get("epochs") or 300), tol=1e-8, **({"weightCol": "weight"} if weighted else {}))
