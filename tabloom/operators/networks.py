"""Networks of ReLU layers (M7, M8), trained where the rows are.

The training rows are written once as blocks. One job is one epoch: every block starts from the common weights, goes
through its rows in mini-batches of ``batch`` in a seeded order, with Adam or with SGD and Nesterov's momentum, and the
blocks' weights and moments are averaged by their numbers of rows, summed by Spark parameter by parameter. A table of one
block (up to ``BLOCK_ROWS`` rows) thus sees the plain sequence of mini-batches; more blocks are local
updates with averaging. With ``lbfgs`` every job gives the loss and gradient of all rows, and the step is a
limited-memory quasi-Newton one with backtracking.

Loss: softmax or logistic cross-entropy, or half the squared error, plus ``alpha`` / 2 times the squared weights, per row. With
early stopping the score on the validation rows (accuracy, or R2) decides: training ends when it has not gained ``TOLERANCE``
for ``PATIENCE`` epochs, and the best weights stay. Without, the training loss decides in the same way.
The driver holds the weights and their sums, whatever the number of partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, ship

BLOCK_ROWS = 1 << 14
PATIENCE, TOLERANCE = 10, 1e-4  # fixed values: when training stops
BETA1, BETA2, EPSILON, MOMENTUM = 0.9, 0.999, 1e-8, 0.9  # fixed values: optimizers
MEMORY = 10


@dataclass
class Network:
    """``weights``: per layer the matrix and the offsets, as lists; ``classes`` 0: a number comes out."""
    weights: list
    classes: int = 0
    epochs: int = 0

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return _forward([(np.asarray(w), np.asarray(b)) for w, b in self.weights], x)[-1]

    def predicted(self, x: np.ndarray) -> np.ndarray:
        out = self.outputs(x)
        if not self.classes:
            return out[:, 0]
        return (out[:, 0] > 0).astype(float) if out.shape[1] == 1 else out.argmax(1).astype(float)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with a vector ``features``) with ``prediction``: a number, or the index of the class."""
        from pyspark.ml.functions import vector_to_array
        ship(df.sparkSession)
        keep = [c for c in df.columns if c != "features"]
        model = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.value.predicted(x))], [*keep, "prediction"])

        narrow = df.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("features").alias("features"))
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
        return narrow.mapInArrow(run, kinds + "prediction double")


def _forward(layers, x: np.ndarray) -> list[np.ndarray]:
    acts = [x]
    for k, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0.0) if k < len(layers) - 1 else z)
    return acts


@dataclass
class _Problem:
    shape: list[int]
    classes: int
    alpha: float

    def layers(self, flat: np.ndarray):
        out, at = [], 0
        for a, b in zip(self.shape, self.shape[1:]):
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.shape, self.shape[1:]):
            bound = math.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)

    def penalized(self, flat: np.ndarray) -> np.ndarray:
        """The weights without the offsets."""
        out = np.zeros_like(flat)
        for (w, _), (v, _) in zip(self.layers(flat), self.layers(out)):
            v[...] = w
        return out

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the rows of the loss and its gradient, without the penalty."""
        layers = self.layers(flat)
        acts = _forward(layers, x)
        out = acts[-1]
        if not self.classes:
            delta = out - y[:, None]
            loss = float((delta * delta).sum()) / 2
        elif out.shape[1] == 1:
            loss = float((np.logaddexp(0, out[:, 0]) - y * out[:, 0]).sum())
            delta = 1 / (1 + np.exp(-np.clip(out, -700, 700))) - y[:, None]
        else:
            top = out.max(1, keepdims=True)
            e = np.exp(out - top)
            whole = e.sum(1, keepdims=True)
            own = y.astype(int)
            loss = float((np.log(whole) + top)[:, 0].sum() - out[np.arange(len(y)), own].sum())
            delta = e / whole
            delta[np.arange(len(y)), own] -= 1
        grad = np.zeros_like(flat)
        for k, (gw, gb) in reversed(list(enumerate(self.layers(grad)))):
            gw[...], gb[...] = acts[k].T @ delta, delta.sum(0)
            if k:
                delta = (delta @ layers[k][0].T) * (acts[k] > 0)
        return loss, grad

    def score(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[float]:
        """Sums that the score is made of: rows, right ones or squared errors, y, y squared."""
        net = Network([(w, b) for w, b in self.layers(flat)], self.classes)
        p = net.predicted(x) if len(x) else np.zeros(0)
        return [len(y), float((p == y).sum()) if self.classes else float(((p - y) ** 2).sum()), float(y.sum()), float((y * y).sum())]

    def scored(self, sums: list[float]) -> float:
        n, part, s, ss = sums
        if self.classes:
            return part / n
        spread = ss - s * s / n
        return 1 - part / spread if spread > 0 else 0.0


def _write(data: DataFrame) -> tuple[DataFrame, int]:
    """The rows (x, label, valid) as a table of blocks (block, n, x, y, v), and the number of training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)
            y, v = t["label"].to_numpy().astype(np.float64), t["valid"].to_numpy().astype(bool)
            order = np.lexsort((*x.T[::-1], y))
            cols = [pa.array([t.num_rows], pa.int32()), *[pa.array([a[order].tobytes()], pa.binary()) for a in (x, y, v)]]
            return pa.RecordBatch.from_arrays(cols, ["n", "x", "y", "v"])

        rows = 0
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(k, BLOCK_ROWS)
                if rows and rows + part.num_rows > BLOCK_ROWS:
                    yield flush()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield flush()

    ship(data.sparkSession)
    counts = {r["valid"]: r["count"] for r in data.groupBy("valid").count().collect()}
    dealt = data.select("x", "label", "valid").repartition(max(1, -(-sum(counts.values()) // BLOCK_ROWS)))
    blocks = dealt.mapInArrow(run, "n int, x binary, y binary, v binary").withColumn("block", F.monotonically_increasing_id())
    return cut_lineage(blocks), counts.get(False, 0)


def _sums(blocks: DataFrame, work) -> dict[int, float]:
    """Sums, by place, of the vectors that ``work`` gives for a block's training and validation rows; negative places are figures."""
    shared = blocks.sparkSession.sparkContext.broadcast(work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.to_pylist():
                x, y, v = np.frombuffer(row["x"]).reshape(row["n"], -1), np.frombuffer(row["y"]), np.frombuffer(row["v"], bool)
                one = shared.value(x[~v], y[~v], x[v], y[v], row["block"])
                total = one if total is None else total + one
        if total is not None:
            figures = shared.value.figures
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) - figures), pa.array(total)], ["place", "value"])

    out = blocks.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    got = dict(zip(out["place"].to_pylist(), out["value"].to_pylist()))
    shared.destroy()
    return got


@dataclass
class _Epoch:
    """A block's share of an epoch: [4 score sums, loss, rows, weights and moments times rows]."""
    problem: _Problem
    state: np.ndarray  # weights, first and second moments
    step: int
    epoch: int
    optimizer: str
    rate: float
    batch: int
    seed: int
    figures = 6

    def __call__(self, x, y, vx, vy, block: int) -> np.ndarray:
        problem, n = self.problem, len(y)
        w, m, v = (p.copy() for p in np.split(self.state, 3))
        score, loss, t = problem.score(w, vx, vy), 0.0, self.step
        order = np.random.Generator(np.random.Philox(key=np.array([self.seed, self.epoch << 40 ^ int(block)], np.uint64))).permutation(n)
        for k in range(0, n, self.batch):
            rows = order[k:k + self.batch]
            part, grad = problem.loss(w, x[rows], y[rows])
            shrink = problem.penalized(w)
            loss += part + problem.alpha / 2 * float(shrink @ shrink)
            grad = (grad + problem.alpha * shrink) / len(rows)
            t += 1
            if self.optimizer == "sgd":
                m = MOMENTUM * m - self.rate * grad
                w = w + MOMENTUM * m - self.rate * grad
            else:
                m = BETA1 * m + (1 - BETA1) * grad
                v = BETA2 * v + (1 - BETA2) * grad * grad
                w = w - self.rate * math.sqrt(1 - BETA2 ** t) / (1 - BETA1 ** t) * m / (np.sqrt(v) + EPSILON)
        return np.concatenate([score, [loss, n], np.concatenate([w, m, v]) * n])


@dataclass
class _Gradient:
    """A block's loss and gradient: [4 score sums, loss, rows, gradient]."""
    problem: _Problem
    w: np.ndarray
    figures = 6

    def __call__(self, x, y, vx, vy, block: int) -> np.ndarray:
        loss, grad = self.problem.loss(self.w, x, y)
        return np.concatenate([self.problem.score(self.w, vx, vy), [loss, len(y)], grad])


class _Watch:
    """The best weights so far, and whether training shall end."""

    def __init__(self):
        self.best, self.weights, self.stall = -math.inf, None, 0

    def ends(self, value: float, weights: np.ndarray) -> bool:
        self.stall = 0 if value > self.best + TOLERANCE else self.stall + 1
        if value > self.best:
            self.best, self.weights = value, weights
        return self.stall > PATIENCE


def fit(data: DataFrame, hidden, classes: int, alpha: float = 1e-4, optimizer: str = "adam", rate: float = 1e-3, epochs: int = 250, batch: int = 32, seed: int = 42,
        early_stopping: bool = False) -> Network:
    """``data``: features (vector), label (number or class index), valid; ``classes`` 0 for regression."""
    from pyspark.ml.functions import vector_to_array
    if optimizer not in ("adam", "sgd", "lbfgs"):
        raise ValueError(f"Optimizer {optimizer!r} is not valid for a network; allowed: adam, lbfgs, sgd")
    blocks, n = _write(data.select(vector_to_array("features").alias("x"), "label", "valid"))
    first = blocks.select((F.octet_length("x") / F.col("n") / 8).cast("int").alias("p")).first()
    if not n or first is None:
        raise ValueError("there are no training rows")
    problem = _Problem([first["p"], *[int(h) for h in hidden], 1 if classes <= 2 else classes], classes, alpha)
    w = problem.start(seed)
    if optimizer == "lbfgs":
        w, done = _quasi_newton(blocks, problem, w, epochs, n)
    else:
        w, done = _mini_batches(blocks, problem, w, optimizer, rate, epochs, min(batch, n), seed, early_stopping)
    return Network([(a.tolist(), b.tolist()) for a, b in problem.layers(w)], classes, done)


def _mini_batches(blocks, problem, w, optimizer, rate, epochs, batch, seed, early_stopping) -> tuple[np.ndarray, int]:
    state, watch, step, size = np.concatenate([w, np.zeros(2 * len(w))]), _Watch(), 0, len(w)
    steps = max(1, -(-BLOCK_ROWS // batch))
    for epoch in range(epochs):
        got = _sums(blocks, _Epoch(problem, state, step, epoch, optimizer, rate, batch, seed))
        rows = got[-1]
        if early_stopping and got[-6] > 0:  # the score of the weights that this epoch began with
            if watch.ends(problem.scored([got[-6 + k] for k in range(4)]), state[:size]):
                return watch.weights, epoch
        state = np.array([got[k] for k in range(3 * size)]) / rows
        step += min(steps, max(1, -(-int(rows) // batch)))
        if not (early_stopping and got[-6] > 0) and watch.ends(-got[-2] / rows, state[:size]):
            return state[:size], epoch + 1
    if early_stopping and watch.weights is not None:
        last = _sums(blocks, _Gradient(problem, state[:size]))
        watch.ends(problem.scored([last[-6 + k] for k in range(4)]), state[:size])
        return watch.weights, epochs
    return state[:size], epochs


def _quasi_newton(blocks, problem, w, epochs: int, n: int) -> tuple[np.ndarray, int]:
    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        got = _sums(blocks, _Gradient(problem, x))
        shrink = problem.penalized(x)
        return (got[-2] + problem.alpha / 2 * float(shrink @ shrink)) / n, (np.array([got[k] for k in range(len(x))]) + problem.alpha * shrink) / n

    loss, grad = at(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(epochs):
        if np.abs(grad).max(initial=0) <= TOLERANCE:
            return w, k
        way = grad.copy()
        back = []
        for s, y in reversed(pairs):
            a = (s @ way) / (s @ y)
            way -= a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(back)):
            way += (a - (y @ way) / (s @ y)) * s
        way, size = -way, 1.0 if pairs else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        slope = float(grad @ way)
        for _ in range(30):
            new, new_grad = at(w + size * way)
            if new <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return w, k
        s, y = size * way, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-MEMORY:]
        if loss - new <= 1e-9 * max(abs(loss), abs(new), 1.0):
            return w + s, k + 1
        w, loss, grad = w + s, new, new_grad
    return w, epochs
