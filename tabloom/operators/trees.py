"""Trees from histograms: gradient boosting (M5, M6) and random forests (M3, M4).

Features are put into at most 255 bins once (quantiles of the training rows), and the training rows are written as
blocks of bins, one byte a value. A pass over the blocks sends each row down the trees as far as they are grown and
counts, for the wanted nodes, the gradients (or class weights) per feature and bin; Spark sums the counts, a
group of a node's sums gives its best split, and the driver gets one row per node. Sums are taken of
integers (gradients scaled to fixed point), so the trees do not depend on how the rows are dealt or in which order
sums arrive.

Boosting grows best-first to ``max_leaf_nodes``: the leaf with the greatest gain is split next. A leaf's gain depends
on its own rows only, so each pass works out all leaves that may still be split, until the open nodes have at most
``LOCAL_ROWS`` different rows: these are brought together by node, and one job works out all splits below. With labels of classes,
rows of equal bins, label and validation flag are counted once and stand for all of them. Gains and leaf values hold the l2 penalty. Rows of the validation slice only serve to
stop early.

Forests weight every row per tree by a Poisson number (the bootstrap in place), try a random subset of the features per
node, and grow until nodes are pure or a limit is reached; there is no depth limit of the engine's own. Nodes with more
than ``LOCAL_ROWS`` rows are split by such passes, all trees of a wave together; the rows of a smaller node are
brought together and its subtree is finished there.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, ship

MAX_BINS = 255
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 12     # so that a block's sums are exact in doubles
LOCAL_ROWS = 1 << 16
WAVE_TREES = 64
WAVE_ROWS = 1 << 27      # bagged rows of a wave that are brought together, about
GROUP_BYTES = 32 << 20   # of trees that a task of a prediction holds at a time
REFRESH = 16             # rounds of boosting between two writings of the rows' scores
MIN_LEAF = 20            # fixed value: rows of a boosting leaf
MIN_HESSIAN = 1e-3       # fixed value
PATIENCE, TOLERANCE = 10, 1e-7  # fixed values: early stopping of boosting


def _typed(kind: str, values) -> array:
    """A typed array, which takes a tenth of a list's memory."""
    if isinstance(values, array):
        return values
    out = array(kind)
    out.frombytes(np.asarray(values, {"i": np.int32, "d": np.float64}[kind]).tobytes())
    return out


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows with x[feature] <= threshold go left. ``value`` has ``width`` numbers a node."""
    feature: array = ()
    threshold: array = ()
    left: array = ()
    right: array = ()
    value: array = ()

    def __post_init__(self):
        self.feature, self.left, self.right = (_typed("i", a) for a in (self.feature, self.left, self.right))
        self.threshold, self.value = (_typed("d", a) for a in (self.threshold, self.value))

    def size(self) -> int:
        """Bytes."""
        return sum(len(a) * a.itemsize for a in (self.feature, self.threshold, self.left, self.right, self.value))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        return _descend(x, *(np.asarray(a) for a in (self.feature, self.threshold, self.left, self.right)))

    def values(self, x: np.ndarray, width: int) -> np.ndarray:
        return np.asarray(self.value, float).reshape(-1, width)[self.leaf_of(x)]


def _descend(x: np.ndarray, feature: np.ndarray, bound: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    live = np.flatnonzero(feature[node] >= 0)
    while len(live):
        at = node[live]
        node[live] = np.where(x[live, feature[at]] <= bound[at], left[at], right[at])
        live = live[feature[node[live]] >= 0]
    return node


@dataclass
class TreeModel:
    """``kind``: 'forest' (values are averaged) or 'boosting' (added up, one tree per output and round)."""
    kind: str
    outputs: int
    base: list[float]
    trees: list[Tree]
    classes: int = 0  # 0: regression
    scale: float = 1.0
    rounds: int = 0

    def start(self, rows: int) -> np.ndarray:
        """What the trees' values are added to."""
        return np.zeros((rows, self.outputs)) if self.kind == "forest" else np.tile(np.asarray(self.base), (rows, 1))

    def add(self, raw: np.ndarray, x: np.ndarray, first: int = 0) -> np.ndarray:
        """``raw`` with the values of this model's trees, the first of which is number ``first`` of the whole model."""
        for k, t in enumerate(self.trees, first):
            if self.kind == "forest":
                raw += t.values(x, self.outputs)
            else:
                raw[:, k % self.outputs] += t.values(x, 1)[:, 0]
        return raw

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = self.add(self.start(len(x)), x)
        return out / len(self.trees) if self.kind == "forest" else out

    def predicted(self, x: np.ndarray) -> np.ndarray:
        return self.told(self.raw(x))

    def told(self, raw: np.ndarray) -> np.ndarray:
        """The predictions, from the sums over all trees."""
        if not self.classes:
            return raw[:, 0] * self.scale
        return (raw[:, 0] > 0).astype(float) if raw.shape[1] == 1 else raw.argmax(1).astype(float)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with a vector ``features``) with ``prediction``: a number, or the index of the class."""
        from pyspark.ml.functions import vector_to_array
        ship(df.sparkSession)
        spark, keep = df.sparkSession, [c for c in df.columns if c != "features"]
        groups = self.groups()

        def part(first: int, trees: list[Tree], opens: bool, closes: bool):
            many = len(self.trees)
            model = spark.sparkContext.broadcast(TreeModel(self.kind, self.outputs, self.base, trees, self.classes, self.scale))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = model.value
                for b in batches:
                    x = _matrix(b.column(len(keep)), b.num_rows)
                    raw = own.add(own.start(b.num_rows) if opens else _matrix(b.column(len(keep) + 1), b.num_rows).copy(), x, first) if b.num_rows else np.zeros((0, own.outputs))
                    if closes:
                        yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(own.told(raw / many if own.kind == "forest" else raw) if b.num_rows else [], pa.float64())], [*keep, "prediction"])
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * own.outputs, pa.int32()), pa.array(raw.ravel()))
                        yield pa.RecordBatch.from_arrays([*b.columns[:len(keep) + 1], lists], [*keep, "features", "__raw"])

            return run

        out = df.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("features").alias("features"))
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out.schema.fields[:-1])
        for k, (first, trees) in enumerate(groups):
            closes = k == len(groups) - 1
            out = out.mapInArrow(part(first, trees, k == 0, closes), kinds + ("prediction double" if closes else "features array<double>, __raw array<double>"))
            if not closes:  # so that no two groups are in tasks at once
                out = cut_lineage(out)
        return out

    def groups(self) -> list[tuple[int, list[Tree]]]:
        """The trees in stretches of at most GROUP_BYTES (one tree at least), each with the number of its first."""
        out, size = [(0, [])], 0
        for k, t in enumerate(self.trees):
            if size + t.size() > GROUP_BYTES and out[-1][1]:
                out.append((k, []))
                size = 0
            out[-1][1].append(t)
            size += t.size()
        return out

    def rows(self) -> list[tuple]:
        return [(k, *(a.tolist() for a in (t.feature, t.threshold, t.left, t.right, t.value))) for k, t in enumerate(self.trees)]

    ROW = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


# ---- bins and blocks -------------------------------------------------------------------------

def bin_edges(data: DataFrame, width: int) -> list[np.ndarray]:
    """Per feature the thresholds between its bins: midpoints between neighbours among its 255 quantiles (extremes included)."""
    probs, out = [k / (MAX_BINS - 1) for k in range(MAX_BINS)], []
    for k in range(0, width, 64):
        cols = [F.percentile_approx(F.col("x")[j], probs, 100_000).alias(f"q{j}") for j in range(k, min(k + 64, width))]
        row = data.agg(*cols).first()
        for q in row:
            v = np.unique(np.asarray(q or [], float))
            out.append((v[1:] + v[:-1]) / 2)
    return out


def write_blocks(data: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Rows (block, n, x, y, w, v, u): bins, labels, weights and the validation flag of some rows each, and the numbers of
    their different rows (empty where most rows differ). ``data``: x, label, weight, valid."""
    shared = data.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, len(shared.value))))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                x = _matrix(part.column(0), part.num_rows)
                bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(shared.value)], 1).astype(np.uint8) if shared.value else np.zeros((part.num_rows, 0), np.uint8)
                y, w = (np.asarray(part.column(c).to_numpy(zero_copy_only=False), np.float64) for c in (1, 2))
                v = np.asarray(part.column(3).to_numpy(zero_copy_only=False), bool)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (bins, y, w, v, _alike(bins, y, w, v))]], ["n", "x", "y", "w", "v", "u"])

    ship(data.sparkSession)
    blocks = data.select("x", "label", "weight", "valid").mapInArrow(run, "n int, x binary, y binary, w binary, v binary, u binary")
    return cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))


def _alike(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The number of each row's content among the different ones; empty if more than half of the rows differ."""
    keys = [*x.T, *others]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    if 2 * new.sum() >= len(order):
        return np.zeros(0, np.uint16)
    out = np.zeros(len(order), np.uint16)  # a block has at most BLOCK_ROWS rows
    out[order] = np.cumsum(new)
    return out


class _Block:
    def __init__(self, row: dict, width: int):
        self.id, self.n = row["block"], row["n"]
        self.x = np.frombuffer(row["x"], np.uint8).reshape(self.n, width)
        self.y, self.w = np.frombuffer(row["y"], np.float64), np.frombuffer(row["w"], np.float64)
        self.v = np.frombuffer(row["v"], bool)
        self.f = np.frombuffer(row["f"], np.float64).reshape(self.n, -1) if row.get("f") is not None else None
        self.m = np.frombuffer(row["m"], np.int64) if row.get("m") is not None else None  # how many rows each one stands for
        self.u = np.frombuffer(row["u"], np.uint16).astype(np.int64) if row.get("u") else None
        if self.u is not None:
            self.first = np.zeros(self.u.max() + 1, np.int64)
            self.first[self.u] = np.arange(self.n)


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Block(b.slice(k, 1).to_pylist()[0], width)


def _counted(blocks: DataFrame, width: int) -> DataFrame:
    """Rows (block, n, x, y, w, v, m): the different rows of all blocks by bins, label and validation flag, and how many there are of each."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches, width):
            first, m = (np.arange(b.n), np.ones(b.n, np.int64)) if b.u is None else (b.first, np.bincount(b.u))
            x = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * width).astype(np.int32)), pa.py_buffer(b.x[first].tobytes())])
            yield pa.RecordBatch.from_arrays([x, pa.array(b.y[first]), pa.array(b.v[first]), pa.array(m)], ["x", "y", "v", "m"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, width)))
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                y, v, m = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                cols = [b"".join(part.column(0).to_pylist()), y.tobytes(), np.ones(len(y)).tobytes(), v.astype(bool).tobytes(), m.astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in cols]], ["n", "x", "y", "w", "v", "m"])

    counted = blocks.mapInArrow(rows, "x binary, y double, v boolean, m long").groupBy("x", "y", "v").agg(F.sum("m").alias("m"))
    return cut_lineage(counted.mapInArrow(again, "n int, x binary, y binary, w binary, v binary, m binary").withColumn("block", F.monotonically_increasing_id()))


def _layout(edges: list[np.ndarray]) -> tuple[np.ndarray, int]:
    sizes = np.array([len(e) + 1 for e in edges], np.int64)
    return np.cumsum(sizes) - sizes, int(sizes.sum())


# ---- boosting --------------------------------------------------------------------------------

class _Growing:
    """A tree that is grown best-first over a tree of splits worked out so far."""

    def __init__(self, max_leaves: int | None, max_depth: int | None):
        self.max_leaves, self.max_depth = max_leaves or 1 << 30, max_depth or 1 << 30
        self.feature, self.bound, self.left, self.right, self.depth = [-1], [0], [-1], [-1], [0]
        self.split: dict[int, dict | None] = {}  # by node: its best split and sums, once known
        self.chosen: set[int] = set()

    def _best_first(self) -> bool:
        """Choose the nodes to split as far as gains are known; whether that is the whole tree."""
        self.chosen, leaves, count = set(), [], itertools.count()
        whole = self._offer(0, leaves, count)
        while whole and leaves and len(self.chosen) + 1 < self.max_leaves:
            _, _, node = heapq.heappop(leaves)
            self.chosen.add(node)
            if len(self.chosen) + 1 >= self.max_leaves:
                return True
            if self.left[node] < 0:
                return False
            whole = all([self._offer(self.left[node], leaves, count), self._offer(self.right[node], leaves, count)])
        return whole

    def _offer(self, node: int, leaves: list, count) -> bool:
        if node not in self.split:
            return False
        s = self.split[node]
        if s["feature"] >= 0 and self.depth[node] < self.max_depth:
            heapq.heappush(leaves, (-s["gain"], node, node))
        return True

    def wanted(self) -> list[int] | None:
        """The nodes whose sums the next pass shall count; None when the tree is complete."""
        if 0 not in self.split:
            return [0]
        if self._best_first():
            return None
        # a leaf among the (leaves left) best may be split: its halves are worked out
        open_ = [n for n, s in self.split.items() if s["feature"] >= 0 and self.left[n] < 0 and self.depth[n] < self.max_depth]
        open_.sort(key=lambda n: (-self.split[n]["gain"], n))
        room = self.max_leaves - 1 - sum(self.left[n] >= 0 for n in self.chosen)
        out = []
        for n in open_[:max(1, room)]:
            s = self.split[n]
            self.feature[n], self.bound[n] = s["feature"], s["bin"]
            for side in (self.left, self.right):
                side[n] = len(self.feature)
                out.append(len(self.feature))
                for a, v in ((self.feature, -1), (self.bound, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[n] + 1)):
                    a.append(v)
        return out

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(a) for a in (self.feature, self.bound, self.left, self.right))

    def add(self, node: int, nodes: list[dict]) -> None:
        """Take over the splits of a node's subtree; ``nodes`` come with their place in it (the node itself is the first) and their left half's."""
        place = {0: node}
        for k, s in enumerate(nodes):
            here = place[k]
            self.split[here] = s
            if s["left"] < 0:
                continue
            self.feature[here], self.bound[here] = s["feature"], s["bin"]
            for side, half in ((self.left, s["left"]), (self.right, s["left"] + 1)):
                side[here] = place[half] = len(self.feature)
                for a, v in ((self.feature, -1), (self.bound, 0), (self.left, -1), (self.right, -1), (self.depth, self.depth[here] + 1)):
                    a.append(v)

    def rows(self, node: int, whole: int) -> int:
        """How many rows a node has."""
        if node == 0:
            return whole
        up = next(n for n, (a, b) in enumerate(zip(self.left, self.right)) if node in (a, b))
        s = self.split[up]
        return s["nl"] if self.left[up] == node else s["n"] - s["nl"]

    def tree(self, edges: list[np.ndarray], rate: float, l2: float, unit: float) -> tuple[Tree, Tree]:
        """The chosen tree, by thresholds and by bins."""
        out, bins = Tree(), Tree()

        def put(node: int, g: float, h: float) -> int:
            here, s = len(out.feature), self.split.get(node)
            for t in (out, bins):
                t.feature.append(-1), t.threshold.append(0.0), t.left.append(-1), t.right.append(-1), t.value.append(float(-rate * g / (h + l2 * unit)) if h + l2 * unit > 0 else 0.0)
            if node in self.chosen:
                f, b = s["feature"], s["bin"]
                out.threshold[here], bins.threshold[here] = float(edges[f][b]), b
                halves = (self.left[node], s["gl"], s["hl"]), (self.right[node], s["g"] - s["gl"], s["h"] - s["hl"])
                left, right = (put(n if n >= 0 else -2, a, c) for n, a, c in halves)
                for t in (out, bins):
                    t.feature[here], t.left[here], t.right[here] = f, left, right
            return here

        root = self.split[0]
        put(0, root["g"], root["h"])
        return out, bins


def fit_boosting(blocks: DataFrame, edges: list[np.ndarray], classes: int, rate: float = 0.1, rounds: int = 200, max_depth: int | None = None,
                 max_leaf_nodes: int | None = 31, l2: float = 0.0, early_stopping: bool = False) -> TreeModel:
    """Squared loss (``classes`` 0), logistic loss (2) or softmax with a tree per class and round (more)."""
    width, outputs = len(edges), 1 if classes <= 2 else classes
    if classes:  # labels repeat, and with them whole rows of bins: each is looked at once a pass
        blocks = _counted(blocks, width)
    sums = blocks.mapInArrow(partial(_label_sums, width=width), "n bigint, s double, low double, high double, c array<double>").toArrow().to_pylist()
    n, different = sum(r["n"] for r in sums), blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if classes:
        share = np.maximum(np.sum([r["c"][:classes] + [0.0] * (classes - len(r["c"])) for r in sums], axis=0) / max(n, 1), 1e-12)
        base, scale = (np.array([math.log(share[1] / share[0])]) if classes <= 2 else np.log(share)), 1.0
    else:
        mean = math.fsum(r["s"] for r in sums) / max(n, 1)
        scale = max([abs(v - mean) for r in sums if r["n"] for v in (r["low"], r["high"])] or [1.0]) or 1.0
        base = np.array([mean / scale])
    unit = float(2 ** max(0, min(38, 58 - max(1, n).bit_length())))  # a block's sums stay below 2^53, all sums below 2^62
    model = TreeModel("boosting", outputs, base.tolist(), [], classes, scale)
    table, pending, losses = blocks, [], []
    for _ in range(rounds):
        growing = [_Growing(max_leaf_nodes, max_depth) for _ in range(outputs)]
        stop, small = False, []
        while (asked := [g.wanted() for g in growing]) != [None] * outputs:
            big = []
            for c, nodes in enumerate(asked):
                for node in nodes or []:
                    # a node has at most as many different rows as the table
                    (small if width and min(growing[c].rows(node, n), different) <= LOCAL_ROWS else big).append((c, node))
            slots = big or small
            work = _Pass(edges, classes, scale, base, pending, [g.arrays() for g in growing], slots, unit)
            best, loss = _best_splits(table, work, l2 * unit, unit) if big else _best_subtrees(table, work, growing, l2 * unit, unit)
            if slots[0][1] == 0:  # the pass over the roots sees the scores of all trees so far
                losses.append(loss)
                stop = early_stopping and _no_gain(losses)
                if stop:
                    break
            for s, (c, node) in enumerate(slots):
                growing[c].add(node, best.get(s, [{"feature": -1, "gain": 0.0, "g": 0, "h": 0, "n": 0, "left": -1}]))
            small = small if big else []
        if stop:
            break
        grown = [g.tree(edges, rate, l2, unit) for g in growing]
        if all(len(t.feature) == 1 for t, _ in grown):
            break
        model.trees += [t for t, _ in grown]
        model.rounds += 1
        pending = pending + [[b for _, b in grown]]
        if len(pending) == REFRESH:
            table = cut_lineage(table.mapInArrow(_rescored(width, base, pending), f"block bigint, n int, x binary, y binary, w binary, v binary, {'m binary, ' if classes else ''}f binary"))
            pending = []
    return model


def _label_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n, s, low, high, c = 0, 0.0, math.inf, -math.inf, np.zeros(1)
    for b in _each(batches, width):
        y = b.y[~b.v]
        m = np.ones(len(y), np.int64) if b.m is None else b.m[~b.v]
        if len(y):
            counts = np.bincount(np.maximum(y, 0).astype(int), m).astype(float) if y.max() < 1 << 16 else np.zeros(1)
            c = np.pad(c, (0, max(0, len(counts) - len(c)))) + np.pad(counts, (0, max(0, len(c) - len(counts))))
            n, s, low, high = n + int(m.sum()), s + float((y * m).sum()), min(low, float(y.min())), max(high, float(y.max()))
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((n, pa.int64()), (s, pa.float64()), (low, pa.float64()), (high, pa.float64()), (c.tolist(), pa.list_(pa.float64())))], ["n", "s", "low", "high", "c"])


def _scores(b: _Block, base: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
    f = np.tile(base, (b.n, 1)) if b.f is None else b.f.copy()
    for trees in pending:
        for c, t in enumerate(trees):
            f[:, c] += t.values(b.x, 1)[:, 0]
    return f


def _rescored(width: int, base: np.ndarray, pending: list[list[Tree]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                f = _scores(_Block(row, width), base, pending)
                kinds = {"block": pa.int64(), "n": pa.int32()}
                row["f"] = f.tobytes()
                names = ["block", "n", "x", "y", "w", "v", *(["m"] if "m" in row else []), "f"]
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in names], names)

    return run


@dataclass
class _Pass:
    """What a pass of boosting needs: bins, the trees so far and the wanted nodes."""
    edges: list[np.ndarray]
    classes: int
    scale: float
    base: np.ndarray
    pending: list[list[Tree]]
    trees: list[tuple[np.ndarray, ...]]
    slots: list[tuple[int, int]]
    unit: float

    def gradients(self, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second derivatives, losses) per row and output."""
        f = _scores(b, self.base, self.pending)
        if not self.classes:
            e = f - (b.y / self.scale)[:, None]
            return e, np.ones_like(e), (e * e)[:, 0] / 2
        if self.classes <= 2:
            p, y = 1 / (1 + np.exp(-f)), b.y[:, None]
            return p - y, p * (1 - p), (np.logaddexp(0, f) - y * f)[:, 0]
        top = f.max(1, keepdims=True)
        whole = np.exp(f - top).sum(1, keepdims=True)
        p, y = np.exp(f - top) / whole, b.y.astype(int)
        return p - (np.arange(f.shape[1]) == y[:, None]), p * (1 - p), (np.log(whole) + top)[:, 0] - f[np.arange(b.n), y]

    def spread(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the wanted nodes with their gradients, and the losses (slot -1)."""
        names, width = ["slot", "x", "g", "h", "m"], len(self.edges)
        for b in _each(batches, width):
            g, h, losses = self.gradients(b)
            m = np.ones(b.n, np.int64) if b.m is None else b.m
            fixed = lambda values: np.rint(values * self.unit).astype(np.int64)
            if b.v.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""]), pa.array([int((fixed(losses[b.v]) * m[b.v]).sum())]), pa.array([0]), pa.array([int(m[b.v].sum())])], names)
            for c, arrays in enumerate(self.trees):
                slot_of = np.full(len(arrays[0]), -1)
                for s, (k, node) in enumerate(self.slots):
                    if k == c:
                        slot_of[node] = s
                slot = slot_of[_descend(b.x, *arrays)]
                mine = np.flatnonzero((slot >= 0) & ~b.v)
                x = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer((np.arange(len(mine) + 1) * width).astype(np.int32)), pa.py_buffer(b.x[mine].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(slot[mine]), x, pa.array(fixed(g[mine, c]) * m[mine]), pa.array(fixed(h[mine, c]) * m[mine]), pa.array(m[mine])], names)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = _layout(self.edges)
        many = len(self.slots)
        g_sum, h_sum, n_sum = (np.zeros(many * total, np.int64) for _ in range(3))
        loss = loss_rows = 0
        for b in _each(batches, len(self.edges)):
            g, h, losses = self.gradients(b)
            watched = b.v if b.v.any() else np.zeros(b.n, bool)
            if b.m is None:
                loss += int(np.rint(losses[watched] * self.unit).sum())
                loss_rows += int(watched.sum())
            else:
                loss += int((np.rint(losses[watched] * self.unit).astype(np.int64) * b.m[watched]).sum())
                loss_rows += int(b.m[watched].sum())
            for c, arrays in enumerate(self.trees):
                slot_of = np.full(len(arrays[0]), -1)
                for s, (k, node) in enumerate(self.slots):
                    if k == c:
                        slot_of[node] = s
                slot = slot_of[_descend(b.x, *arrays)]
                mine = np.flatnonzero((slot >= 0) & ~b.v)
                if not len(mine):
                    continue
                key = (slot[mine, None] * total + first + b.x[mine]).ravel()
                for out, values in ((g_sum, g[mine, c]), (h_sum, h[mine, c])):
                    values = np.rint(values * self.unit)
                    if b.m is None:
                        out += np.bincount(key, np.repeat(values, b.x.shape[1]), many * total).astype(np.int64)
                        continue
                    out += _exact(key, np.repeat(values.astype(np.int64) * b.m[mine], b.x.shape[1]), many * total)
                n_sum += np.bincount(key, None if b.m is None else np.repeat(b.m[mine], b.x.shape[1]), many * total).astype(np.int64)
        at = np.flatnonzero(n_sum)
        slot, spot = at // max(total, 1), at % max(total, 1)
        feature = np.searchsorted(first, spot, "right") - 1
        cols = [slot, feature, spot - (first[feature] if len(first) else 0), g_sum[at], h_sum[at], n_sum[at]]
        cols = [np.append(c, v) for c, v in zip(cols, (-1, 0, 0, loss, 0, loss_rows))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["slot", "feature", "bin", "g", "h", "n"])


def _exact(key: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of integers by key. They can pass 2^53, so they are taken of two halves."""
    return sum(np.bincount(key, half, size).astype(np.int64) << shift for half, shift in ((values >> 29, 29), (values & (1 << 29) - 1, 0)))


def _split_of(feature: np.ndarray, bin_: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, unit: float) -> dict:
    """The best split of a node from its sums per feature and bin, in this order."""
    start = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    row = {"feature": -1, "bin": 0, "gain": 0.0, "gl": 0, "hl": 0, "nl": 0} | {k: int(v[feature == feature[0]].sum()) for k, v in (("g", g), ("h", h), ("n", n))}
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(feature))))
    gl, hl, nl = (np.cumsum(v) - (np.cumsum(v) - v)[start][of] for v in (g, h, n))
    gr, hr, nr = row["g"] - gl, row["h"] - hl, row["n"] - nl
    fit = (nl >= MIN_LEAF) & (nr >= MIN_LEAF) & (hl >= MIN_HESSIAN * unit) & (hr >= MIN_HESSIAN * unit)
    f = lambda a, b: a.astype(float) ** 2 / np.maximum(b + l2, 1e-300)
    gain = np.where(fit, f(gl, hl) + f(gr, hr) - float(row["g"]) ** 2 / max(row["h"] + l2, 1e-300), -1.0) / unit
    if len(gain) and gain.max() > 1e-12:
        k = int(gain.argmax())
        row |= {"feature": int(feature[k]), "bin": int(bin_[k]), "gain": float(gain[k]), "gl": int(gl[k]), "hl": int(hl[k]), "nl": int(nl[k])}
    return row


_SPLIT = ["feature", "bin", "gain", "gl", "hl", "nl", "g", "h", "n"]


def _best_splits(table: DataFrame, work: _Pass, l2: float, unit: float) -> tuple[dict[int, list[dict]], float | None]:
    """The best split of each wanted node that has one, with the node's sums, and the mean loss of the validation slice. Spark sums and compares; a row per node comes back."""
    shared = table.sparkSession.sparkContext.broadcast(work)
    counts = table.mapInArrow(lambda batches: shared.value(batches), "slot long, feature long, bin long, g long, h long, n long")
    # a task's counts are sums already: dealt by node, they are added up and compared after one shuffle
    summed = counts.repartition("slot").groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])

    def best(group: pa.Table) -> pa.Table:
        slot, feature, bin_, g, h, n = (group.column(c).to_numpy() for c in ("slot", "feature", "bin", "g", "h", "n"))
        if slot[0] < 0:
            row = dict.fromkeys(_SPLIT, 0) | {"g": int(g.sum()), "n": int(n.sum())}
        else:
            order = np.lexsort((bin_, feature))
            row = _split_of(feature[order], bin_[order], g[order], h[order], n[order], l2, unit)
        return pa.table({"slot": pa.array([int(slot[0])], pa.int64())} | {k: pa.array([row[k]], pa.float64() if k == "gain" else pa.int64()) for k in _SPLIT})

    found = summed.groupBy("slot").applyInArrow(best, "slot long, feature long, bin long, gain double, gl long, hl long, nl long, g long, h long, n long").toArrow().to_pylist()
    loss = next((r["g"] / unit / r["n"] for r in found if r["slot"] < 0 and r["n"]), None)
    return {r["slot"]: [r | {"left": -1}] for r in found if r["slot"] >= 0}, loss


def _best_subtrees(table: DataFrame, work: _Pass, growing: list[_Growing], l2: float, unit: float) -> tuple[dict[int, list[dict]], float | None]:
    """The splits of each wanted node's whole subtree, as far as a tree can take them, and the loss. The rows of a node,
    at most LOCAL_ROWS different ones, are brought together; one row per split comes back."""
    spark = table.sparkSession
    limits = {s: (growing[c].max_leaves - 1, growing[c].max_depth - growing[c].depth[node]) for s, (c, node) in enumerate(work.slots)}
    shared = spark.sparkContext.broadcast((work, limits))
    spread = table.mapInArrow(lambda batches: shared.value[0].spread(batches), "slot long, x binary, g long, h long, m long")

    def finish(group: pa.Table) -> pa.Table:
        work, limits = shared.value
        slot, g, h, m = (group.column(c).to_numpy() for c in ("slot", "g", "h", "m"))
        if slot[0] < 0:
            nodes = [dict.fromkeys([*_SPLIT, "left"], 0) | {"g": int(g.sum()), "n": int(m.sum())}]
        else:
            x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.uint8).reshape(len(g), -1)
            nodes = boost_here(x, g, h, m, work.edges, *limits[int(slot[0])], l2, unit)
        cols = {"slot": pa.array([int(slot[0])] * len(nodes), pa.int64()), "place": pa.array(range(len(nodes)), pa.int64())}
        return pa.table(cols | {k: pa.array([r[k] for r in nodes], pa.float64() if k == "gain" else pa.int64()) for k in [*_SPLIT, "left"]})

    found = spread.groupBy("slot").applyInArrow(finish, "slot long, place long, feature long, bin long, gain double, gl long, hl long, nl long, g long, h long, n long, left long").toArrow().to_pylist()
    out: dict[int, list[dict]] = {}
    for r in sorted(found, key=lambda r: (r["slot"], r["place"])):
        out.setdefault(r["slot"], []).append(r)
    loss = next((r["g"] / unit / r["n"] for r in out.pop(-1, []) if r["n"]), None)
    return out, loss


def boost_here(x: np.ndarray, g: np.ndarray, h: np.ndarray, m: np.ndarray, edges: list[np.ndarray], splits: int, depth: int, l2: float, unit: float) -> list[dict]:
    """The nodes of a subtree whose rows (bins, fixed-point gradients, numbers) are all here, best first, with at most ``splits`` splits."""
    first, total = _layout(edges)
    of = np.repeat(np.arange(len(edges)), [len(e) + 1 for e in edges])
    nodes, parts, count, leaves = [], [], 0, []

    def put(rows: np.ndarray, d: int) -> None:
        key = (first + x[rows]).ravel()
        sums = [_exact(key, np.repeat(v[rows], x.shape[1]), total) for v in (g, h, m)]
        at = np.flatnonzero(sums[2])
        nodes.append(_split_of(of[at], at - first[of[at]], *[v[at] for v in sums], l2, unit) | {"left": -1})
        parts.append((rows, d))
        if nodes[-1]["feature"] >= 0 and d < depth:
            heapq.heappush(leaves, (-nodes[-1]["gain"], len(nodes) - 1))

    put(np.arange(len(x)), 0)
    while leaves and count < splits:
        _, k = heapq.heappop(leaves)
        count += 1
        (rows, d), s = parts[k], nodes[k]
        parts[k] = None
        goes = x[rows, s["feature"]] <= s["bin"]
        s["left"] = len(nodes)
        put(rows[goes], d + 1)
        put(rows[~goes], d + 1)
    return nodes


def _no_gain(losses: list[float | None]) -> bool:
    """No loss of the last PATIENCE rounds is better than the one before them."""
    if len(losses) <= PATIENCE or losses[-1] is None:
        return False
    return all(v >= losses[-PATIENCE - 1] - TOLERANCE for v in losses[-PATIENCE:])


# ---- forests ---------------------------------------------------------------------------------

@dataclass
class Forest:
    """Settings of a forest: ``tries`` features are tried per node; a node is split if it has ``min_split`` rows and both sides ``min_leaf``."""
    trees: int
    outputs: int  # classes, or 1
    classes: int
    tries: int
    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    seed: int = 42
    mean: float = 0.0
    unit: float = 1.0

    def bag(self, tree: int, b: _Block) -> np.ndarray:
        rng = np.random.Generator(np.random.Philox(key=np.array([self.seed * 1_000_003 + tree, int(b.id)], np.uint64)))
        return np.where(b.v, 0, rng.poisson(1.0, b.n))

    def bagged(self, tree: int, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different rows in a tree's bootstrap: the place of one of each, how many rows of them are in it, and their bootstrap numbers' sum."""
        bag = self.bag(tree, b)
        if b.u is None:
            rows = np.flatnonzero(bag)
            return rows, np.ones(len(rows), np.int64), bag[rows]
        count, total = (np.bincount(b.u, v, len(b.first)).astype(np.int64) for v in (bag > 0, bag))
        at = np.flatnonzero(count)
        return b.first[at], count[at], total[at]

    def targets(self, b: _Block) -> np.ndarray:
        """Per row and output, fixed-point: the weight in the class's column, or the weighted label less the mean; the weight itself comes first."""
        w = np.rint(b.w * self.unit)
        if self.classes:
            return np.column_stack([w, w[:, None] * (np.arange(self.outputs) == b.y[:, None])]).astype(np.int64)
        return np.column_stack([w, np.rint(b.w * (b.y - self.mean) * self.unit)]).astype(np.int64)

    def features(self, tree: int, node: int, width: int) -> np.ndarray:
        """The order in which a node tries its features."""
        return np.random.Generator(np.random.Philox(key=np.array([self.seed * 1_000_003 + tree, node ^ (1 << 63)], np.uint64))).permutation(width)

    def value(self, sums: np.ndarray) -> list[float]:
        w = max(float(sums[0]), 1e-300)
        return (sums[1:] / w).tolist() if self.classes else [self.mean + float(sums[1]) / w]

    def split(self, hist: np.ndarray, rows: np.ndarray) -> tuple[float, int] | None:
        """Best (score, bin) of a feature from its sums (bin x stat) and numbers of rows per bin; None if no bin parts the node."""
        left, n = np.cumsum(hist, 0)[:-1], np.cumsum(rows)[:-1]
        whole = hist.sum(0)
        right = whole - left
        fit = (n >= self.min_leaf) & (rows.sum() - n >= self.min_leaf) & (n > 0) & (n < rows.sum()) & (left[:, 0] > 0) & (right[:, 0] > 0)
        if not fit.any():
            return None
        part = lambda s: (s[:, 1:].astype(float) ** 2).sum(1) / np.maximum(s[:, 0].astype(float), 1e-300)
        score = np.where(fit, part(left) + part(right), -np.inf)
        k = int(score.argmax())
        return float(score[k]), k


def _child(node: int, side: int) -> int:
    """A name of 63 bits for a node, by its parent's and the side."""
    x = (node * 2 + side + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return (x ^ x >> 31) >> 1


def _done(forest: Forest, sums: np.ndarray, n: int, depth: int) -> bool:
    pure = forest.classes and (sums[1:] > 0).sum() <= 1
    return bool(n < forest.min_split or n < 2 * forest.min_leaf or n < 2 or pure or (forest.max_depth is not None and depth >= forest.max_depth))


def grow_here(forest: Forest, tree: int, name: int, depth: int, x: np.ndarray, t: np.ndarray, bag: np.ndarray, many: np.ndarray, edges: list[np.ndarray]) -> Tree:
    """The subtree of a node whose rows (bins, targets, bootstrap numbers, how many rows each stands for) are all here."""
    out = Tree()
    t = t * bag[:, None]

    def leaf(sums: np.ndarray) -> int:
        for a, v in ((out.feature, -1), (out.threshold, 0.0), (out.left, -1), (out.right, -1)):
            a.append(v)
        out.value.extend(forest.value(sums))
        return len(out.feature) - 1

    stack = [(np.arange(len(x)), name, depth, leaf(t.sum(0)))]
    while stack:
        rows, name, depth, here = stack.pop()
        sums = t[rows].sum(0)
        if _done(forest, sums, int(many[rows].sum()), depth) or not x.shape[1] or (not forest.classes and (t[rows, 1] * bag[rows[0]] == t[rows[0], 1] * bag[rows]).all()):
            continue
        best = None
        for tried, f in enumerate(forest.features(tree, name, x.shape[1])):
            if tried >= forest.tries and best:
                break
            b = x[rows, f]
            low, high = int(b.min()), int(b.max())
            if low == high:
                continue
            b = b.astype(np.int64) - low
            hist = np.stack([np.bincount(b, t[rows, c], high - low + 1) for c in range(t.shape[1])], 1)
            got = forest.split(hist, np.bincount(b, many[rows], high - low + 1))
            if got and (best is None or (got[0], -f) > (best[0], -best[1])):
                best = (got[0], int(f), got[1] + low)
        if best is None:
            continue
        _, f, cut = best
        goes = x[rows, f] <= cut
        out.feature[here], out.threshold[here] = f, float(edges[f][cut])
        halves = rows[goes], rows[~goes]
        out.left[here], out.right[here] = (leaf(t[h].sum(0)) for h in halves)
        stack += [(h, _child(name, s), depth + 1, n) for s, (h, n) in enumerate(zip(halves, (out.left[here], out.right[here])))]
    return out


def fit_forest(blocks: DataFrame, edges: list[np.ndarray], forest: Forest) -> TreeModel:
    """A forest of ``forest.trees`` trees, in waves."""
    width = len(edges)
    n, most, total, weight = blocks.mapInArrow(partial(_forest_sums, width=width, classes=forest.classes), "n bigint, m double, s double, w double").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("m"), F.lit(1.0)), F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(1.0))).first()
    forest.mean = 0.0 if forest.classes else total / max(weight, 1e-300)
    top = max(1.0, most + abs(forest.mean))
    forest.unit = float(2 ** max(-40, min(40, 46 - max(1, n).bit_length()))) / top  # exact in doubles, bootstrap numbers included
    step, trees = max(1, min(WAVE_TREES, WAVE_ROWS // max(1, n))), []
    for k in range(0, forest.trees, step):
        trees += _wave(blocks, edges, forest, list(range(k, min(forest.trees, k + step))), n)
    return TreeModel("forest", forest.outputs, [], trees, forest.classes)


def _forest_sums(batches: Iterator[pa.RecordBatch], width: int, classes: int) -> Iterator[pa.RecordBatch]:
    n, m, s, w = 0, 1.0, 0.0, 0.0
    for b in _each(batches, width):
        y, own = b.y[~b.v], b.w[~b.v]
        n, m = n + len(y), max(m, float(own.max(initial=0)), 0.0 if classes else float(np.abs(y * own).max(initial=0)))
        s, w = s + float((y * own).sum()), w + float(own.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m]), pa.array([s]), pa.array([w])], ["n", "m", "s", "w"])


def _wave(blocks: DataFrame, edges: list[np.ndarray], forest: Forest, numbers: list[int], n: int) -> list[Tree]:
    """The upper parts of the wave's trees by passes, until every node is small, then all subtrees at once."""
    names = {t: [1] for t in numbers}  # a node's name, by tree and place
    upper = {t: Tree([-1], [0.0], [-1], [-1], [0.0] * forest.outputs) for t in numbers}
    bins = {t: [0] for t in numbers}
    depths = {t: [0] for t in numbers}
    big = [(t, 0) for t in numbers] if n > LOCAL_ROWS else []
    final, wide = set(), set()  # nodes that stay leaves, and nodes that none of the first features parts
    while big:
        work = _ForestPass(forest, edges, {t: _arrays(upper[t], bins[t]) for t in numbers}, big, [names[t][k] for t, k in big], [len(edges) if b in wide else forest.tries for b in big])
        best = _forest_pass(blocks, forest, work)
        grown = []
        for s, (t, node) in enumerate(big):
            r = best.get(s)
            if r and r["feature"] < 0 and not r["pure"] and (t, node) not in wide and not _done(forest, np.asarray(r["sums"]), r["n"], depths[t][node]):
                wide.add((t, node))
                grown.append((t, node))
                continue
            if r is None or r["feature"] < 0 or _done(forest, np.asarray(r["sums"]), r["n"], depths[t][node]):
                final.add((t, node))
                upper[t].value[node * forest.outputs:(node + 1) * forest.outputs] = array("d", forest.value(np.asarray(r["sums"])) if r else [0.0] * forest.outputs)
                continue
            tree = upper[t]
            tree.feature[node], tree.threshold[node], bins[t][node] = r["feature"], float(edges[r["feature"]][r["bin"]]), r["bin"]
            for side, rows in ((0, r["nl"]), (1, r["n"] - r["nl"])):
                (tree.left, tree.right)[side][node] = here = len(tree.feature)
                for a, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (bins[t], 0), (depths[t], depths[t][node] + 1), (names[t], _child(names[t][node], side))):
                    a.append(v)
                tree.value.extend([0.0] * forest.outputs)
                if rows > LOCAL_ROWS:
                    grown.append((t, here))
        big = grown
    open_ = {t: [k for k, f in enumerate(upper[t].feature) if f < 0 and (t, k) not in final] for t in numbers}
    for (t, node), sub in _subtrees(blocks, edges, forest, upper, bins, names, depths, open_).items():
        _graft(upper[t], node, sub, forest.outputs)
    return [upper[t] for t in numbers]


def _arrays(tree: Tree, bins: list[int]) -> tuple[np.ndarray, ...]:
    return tuple(np.array(a) for a in (tree.feature, bins, tree.left, tree.right))  # copies: the tree goes on growing


def _graft(tree: Tree, node: int, sub: Tree, outputs: int) -> None:
    """Put a subtree in a leaf's place."""
    base = len(tree.feature) - 1  # the subtree's node k > 0 becomes base + k
    left, right = (_typed("i", np.where((k := np.asarray(a)) > 0, k + base, -1)) for a in (sub.left, sub.right))
    for a, own in ((tree.feature, sub.feature), (tree.threshold, sub.threshold), (tree.left, left), (tree.right, right)):
        a[node] = own[0]
        a.extend(own[1:])
    tree.value.extend(sub.value[outputs:])
    tree.value[node * outputs:(node + 1) * outputs] = sub.value[:outputs]


def _subtrees(blocks: DataFrame, edges: list[np.ndarray], forest: Forest, upper: dict, bins: dict, names: dict, depths: dict, open_: dict) -> dict[tuple[int, int], Tree]:
    width = len(edges)
    shared = blocks.sparkSession.sparkContext.broadcast((forest, edges, {t: _arrays(upper[t], bins[t]) for t in upper}, names, depths, {t: set(k) for t, k in open_.items()}))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _, trees, _, _, open_ = shared.value
        for b in _each(batches, width):
            targets = forest.targets(b)
            for t, arrays in trees.items():
                rows, many, total = forest.bagged(t, b)
                node = _descend(b.x[rows], *arrays)
                for k in np.unique(node):
                    if k in open_[t]:
                        own = node == k
                        mine = rows[own]
                        cols = [pa.array([t], pa.int32()), pa.array([k], pa.int32()), pa.array([int(b.id)], pa.int64()),
                                *[pa.array([a.tobytes()], pa.binary()) for a in (b.x[mine], targets[mine], total[own], many[own])]]
                        yield pa.RecordBatch.from_arrays(cols, ["tree", "node", "block", "x", "t", "bag", "many"])

    def finish(group: pa.Table) -> pa.Table:
        forest, edges, _, names, depths, _ = shared.value
        t, node = group["tree"][0].as_py(), group["node"][0].as_py()
        group = group.sort_by("block")
        join = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), kind)
        bag = join("bag", np.int64)
        sub = grow_here(forest, t, names[t][node], depths[t][node], join("x", np.uint8).reshape(len(bag), width), join("t", np.int64).reshape(len(bag), -1), bag, join("many", np.int64), edges)
        out = TreeModel("forest", forest.outputs, [], [sub]).rows()[0]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        return pa.table([pa.array([t], pa.int32()), pa.array([node], pa.int32()), *[pa.array([v], kind) for v, kind in zip(out[1:], kinds)]],
                        ["tree", "node", "feature", "threshold", "left", "right", "value"])

    dealt = blocks.mapInArrow(deal, "tree int, node int, block long, x binary, t binary, bag binary, many binary")
    grown = dealt.groupBy("tree", "node").applyInArrow(finish, "tree int, node int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>")
    return {(b.column(0)[k].as_py(), b.column(1)[k].as_py()): Tree(*[b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(2, 7)])
            for b in grown.toArrow().to_batches() for k in range(b.num_rows)}


@dataclass
class _ForestPass:
    forest: Forest
    edges: list[np.ndarray]
    trees: dict[int, tuple[np.ndarray, ...]]
    slots: list[tuple[int, int]]
    names: list[int]
    tries: list[int]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, width = self.forest, len(self.edges)
        sizes = [len(e) + 1 for e in self.edges]
        sums: dict[tuple[int, int], np.ndarray] = {}
        ends: dict[int, tuple[int, int]] = {}  # by slot: the least and the greatest target
        slot_of = {}
        for s, (t, node) in enumerate(self.slots):
            slot_of.setdefault(t, {})[node] = s
        for b in _each(batches, width):
            targets = forest.targets(b)
            for t, own in slot_of.items():
                rows, many, total = forest.bagged(t, b)
                node = _descend(b.x[rows], *self.trees[t])
                for k, s in own.items():
                    here = np.flatnonzero(node == k)
                    if not len(here):
                        continue
                    mine = rows[here]
                    weighted = targets[mine] * total[here, None]
                    if not forest.classes:
                        low, high = int(targets[mine, 1].min()), int(targets[mine, 1].max())
                        ends[s] = (min(low, ends[s][0]), max(high, ends[s][1])) if s in ends else (low, high)
                    for f in forest.features(t, self.names[s], width)[:self.tries[s]]:
                        x = b.x[mine, f]
                        hist = np.stack([np.bincount(x, many[here], sizes[f]), *[np.bincount(x, weighted[:, c], sizes[f]) for c in range(weighted.shape[1])]], 1).astype(np.int64)
                        sums[s, f] = sums[s, f] + hist if (s, f) in sums else hist
        for (s, f), hist in sums.items():
            at = np.flatnonzero(hist[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(np.full(len(at), f)), pa.array(at), pa.array(hist[at].tolist(), pa.list_(pa.int64()))],
                                             ["slot", "feature", "bin", "stats"])
        for s, pair in ends.items():  # as bins of a feature -1
            yield pa.RecordBatch.from_arrays([pa.array([s, s]), pa.array([-1, -1]), pa.array(pair, pa.int64()), pa.array([[0, 0, 0]] * 2, pa.list_(pa.int64()))], ["slot", "feature", "bin", "stats"])


def _forest_pass(blocks: DataFrame, forest: Forest, work: _ForestPass) -> dict[int, dict]:
    """The best split of each wanted node over the features it tries."""
    shared = blocks.sparkSession.sparkContext.broadcast(work)
    many = forest.outputs + 2 if forest.classes else 3
    counts = blocks.mapInArrow(lambda batches: shared.value(batches), "slot long, feature long, bin long, stats array<long>")
    summed = counts.repartition("slot").groupBy("slot", "feature", "bin").agg(F.array(*[F.sum(F.col("stats")[k]) for k in range(many)]).alias("stats"))

    def best(group: pa.Table) -> pa.Table:
        work = shared.value
        forest = work.forest
        slot, feature, bin_ = (group.column(c).to_numpy() for c in ("slot", "feature", "bin"))
        stats = np.array(group.column("stats").to_pylist(), np.int64)
        row = {"slot": int(slot[0]), "feature": -1, "bin": 0, "nl": 0, "n": 0, "pure": int((feature < 0).sum() == 1), "sums": []}
        found = None
        for tried, f in enumerate(forest.features(work.slots[slot[0]][0], work.names[slot[0]], len(work.edges))[:work.tries[slot[0]]]):
            if tried >= forest.tries and found:
                break
            mine = np.flatnonzero(feature == f)
            mine = mine[np.argsort(bin_[mine])]
            row |= {"n": int(stats[mine, 0].sum()), "sums": stats[mine, 1:].sum(0).tolist()}
            got = None if row["pure"] else forest.split(stats[mine, 1:], stats[mine, 0])
            if got and (found is None or (got[0], -f) > found):
                found = got[0], -f
                row |= {"feature": int(f), "bin": int(bin_[mine[got[1]]]), "nl": int(stats[mine[:got[1] + 1], 0].sum())}
        kinds = {"sums": pa.list_(pa.int64())}
        return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})

    found = summed.groupBy("slot").applyInArrow(best, "slot long, feature long, bin long, nl long, n long, pure long, sums array<long>")
    return {r["slot"]: r for r in found.toArrow().to_pylist()}


def tries_of(setting, width: int, default: str) -> int:
    """Features tried per node: 'sqrt', 'log2', 'all', a share of the features or a number."""
    setting = default if setting is None else setting
    if isinstance(setting, str):
        many = {"sqrt": math.sqrt(width), "log2": math.log2(max(width, 1)), "all": width}[setting]
    else:
        many = setting * width if isinstance(setting, float) else setting
    return max(1, min(width, int(many)))


def fit(data: DataFrame, model: str, params: dict, training: dict, classes: int) -> TreeModel:
    """A forest or boosting model of the catalog. ``data``: features (vector), label, weight, valid; ``classes`` 0 for regression."""
    from pyspark.ml.functions import vector_to_array
    rows = data.select(vector_to_array("features").alias("x"), "label", "weight", "valid")
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("there are no training rows")
    edges = bin_edges(rows, first["n"])
    blocks = write_blocks(rows, edges)
    depth = params.get("max_depth")
    if model.startswith("random_forest"):
        forest = Forest(trees=int(params.get("n_estimators", 300)), outputs=max(1, classes), classes=classes,
                        tries=tries_of(params.get("max_features"), first["n"], "sqrt" if classes else "all"), max_depth=None if depth is None else int(depth),
                        min_leaf=int(params.get("min_samples_leaf", 1)), min_split=int(params.get("min_samples_split", 2)), seed=int(training.get("random_seed", 42)))
        return fit_forest(blocks, edges, forest)
    return fit_boosting(blocks, edges, classes, rate=float(training.get("learning_rate") or 0.1), rounds=int(training.get("epochs") or 200),
                        max_depth=None if depth is None else int(depth), max_leaf_nodes=params.get("max_leaf_nodes"), l2=float(params.get("l2_regularization") or 0.0),
                        early_stopping=bool(training.get("early_stopping")))
