"""Hard negatives by lists shared within clusters of anchors (MAXIMUS style), exact.

Components become integers floor(scale x); a row's score for an anchor is their integer inner product, higher scores come
first and ties by smaller id. An anchor's positives are its first rows of the same label; for each positive the first rows of
another label whose score lies between two percentages of the positive's score are its hard negatives.

Anchors are clustered by direction (spherical k-means on at most ``SAMPLE`` of them, at most ``MAX_CLUSTERS``
clusters). With t the largest angle between a cluster's centroid and a member, and a the angle between centroid and candidate, no
member u can score more than |u| |x| cos(max(0, a - t)) on candidate x. That bound, without |u|, orders the
cluster's list of candidates. It is worked out once and written with the candidates, as one of ``BINS`` levels per
cluster. All members of a cluster walk the list from its top: each round takes the next stretch of the list, four times
what was walked before, splits it into parts of ``LIST_ROWS`` candidates, and joins each part with a block of at most
``BLOCK`` members that are still open; there each member goes down the part by falling bound until it is beaten. The parts'
finds are merged per anchor. A member is closed, with a certificate, when |u| times the bound of the rest of
its list is below its worst find, or below the least score that it asks for. So no list, cluster or member block is ever held whole
by a task or the driver, which knows the lists' histograms only.

Rows with a null id, label or vector, or with a null or non-finite component take no part; neither do vectors whose
scaled length is 2^31 or more, whose products need not fit a BIGINT. Vectors are only compared with those of their dimension. Zero and
empty vectors take part (score 0). Equal rows are rows of their own: each is another row for the others, and an anchor that occurs
twice is reported twice. Extra columns are ignored. No anchor or an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import drop, keep, ship

SAMPLE = 8192         # anchors that the centroids are fitted on, at most
MEMBERS = 256         # anchors a cluster, until MAX_CLUSTERS
MAX_CLUSTERS = 64     # two bytes of a candidate's row each
BINS = 4096           # levels of a list
BLOCK = 1024          # members walking together
LIST_ROWS = 8192      # candidates of a part
STEP = 512            # candidates between two looks at who is open
GROWTH = 4
SLACK = 1e-6          # of |u| |x|: far above what rounding does to a bound
NOT_LISTED = 65535
LIMIT = float(1 << 31)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row where ``is_anchor`` (a
    condition on ``id_col``, ``label_col`` and ``vec_col``) and each of its first ``positives`` rows, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LIMIT))
    rows = rows.where("id is not null and label is not null").where(F.coalesce(finite, F.lit(False))).withColumn("v", F.transform("x", lambda c: F.floor(c * scale).cast("long")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    rows = rows.select("id", "label", "v", "anchor", length.alias("length")).where(F.col("length") < LIMIT)

    plain = keep(rows.where("anchor").groupBy("id", "label", "v", "length").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.monotonically_increasing_id()))
    centroids = _centroids(plain)
    anchors = keep(plain.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids)),
                                    "key bigint, id bigint, label string, copies bigint, length double, v binary, cluster int, angle double"))
    drop(plain)
    widest = {r["cluster"]: (r["angle"], r["n"]) for r in anchors.groupBy("cluster").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect()}
    top = rows.agg(F.max("length")).first()[0] or 0.0
    lists = keep(rows.select("id", "label", "v", "length").mapInArrow(
        _levels(spark.sparkContext.broadcast((centroids, {c: a for c, (a, _) in widest.items()}, top))), "id bigint, label string, v binary, levels binary"))
    walk = _Walk(anchors, lists, widest, top)

    found = walk.run(anchors.withColumn("asks", F.expr("cast(array() as array<bigint>)")), positives, None)
    again = anchors.where("copies > 1").select("key", F.col("id").alias("other"), F.round(F.col("length") * F.col("length")).cast("long").alias("score"),
                                               F.explode(F.sequence(F.lit(2), F.least(F.col("copies"), F.lit(positives + 1)))).alias("n"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    pairs = keep(found.select("key", "other", "score").unionByName(again.select("key", "other", "score")).withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= positives))
    asks = pairs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "score"))).alias("s")).select("key", F.col("s.score").alias("asks"))
    hard = walk.run(anchors.join(asks, "key"), negatives, (low, high))
    rank = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "other")
    out = hard.select("key", "slot", F.row_number().over(rank).alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(pairs.select("key", "slot", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "slot"])
    out = out.join(anchors.select("key", F.col("id").alias("anchor_id"), "copies"), "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _centroids(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension some unit vectors, fitted on a bounded sample of the anchors in the order of their hashes; a zero
    vector stands for a dimension that the sample lacks."""
    dims = {r["d"]: r["n"] for r in anchors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = anchors.select("v", F.xxhash64("id", "label").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
    out = {}
    for d, n in sorted(dims.items()):
        own = [r["v"] for r in rows if len(r["v"]) == d and any(r["v"])]
        x = np.array(own, np.float64).reshape(len(own), d)
        want = min(max(1, MAX_CLUSTERS * n // sum(dims.values())), -(-n // MEMBERS), len(x))
        out[d] = _spherical_means(x / np.sqrt((x * x).sum(1, keepdims=True)), want) if want else np.zeros((1, d))
    return out


def _spherical_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k directions: farthest-first seeds, then k-means by cosine."""
    seeds, near = [0], x @ x[0]
    while len(seeds) < k:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def _first_cluster(centroids: dict[int, np.ndarray]) -> dict[int, int]:
    out, n = {}, 0
    for d in sorted(centroids):
        out[d], n = n, n + len(centroids[d])
    return out


def _matrices(column: pa.Array):
    """(positions, integer matrix) of an Arrow list column, by dimension."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        mine = np.flatnonzero(sizes == d)
        yield mine, flat[at[mine][:, None] + np.arange(d)].astype(np.int64).reshape(len(mine), int(d))


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angles between rows of x and unit centroids; 0 where either is a zero vector."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where((size > 0) & ((c * c).sum(1) > 0), np.arccos(np.clip(x @ c.T / np.where(size > 0, size, 1), -1, 1)), 0.0)


def _assigned(centroids):
    def run(batches):
        first = _first_cluster(centroids.value)
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            cluster, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            v = np.empty(b.num_rows, object)
            for mine, x in _matrices(col["v"]):
                t = _angles(x.astype(np.float64), centroids.value[x.shape[1]])
                home = t.argmin(1)
                cluster[mine], angle[mine] = first[x.shape[1]] + home, t[np.arange(len(mine)), home]
                for k, row in zip(mine, x):
                    v[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(col[n] for n in ("key", "id", "label", "copies", "length")), pa.array(v, pa.binary()), pa.array(cluster), pa.array(angle)],
                                             ["key", "id", "label", "copies", "length", "v", "cluster", "angle"])

    return run


def _levels(shared):
    """Candidates with the level of their bound in each cluster's list, two bytes each."""

    def run(batches):
        centroids, widest, top = shared.value
        first = _first_cluster(centroids)
        total = sum(map(len, centroids.values()))
        for b in batches:
            levels, v = np.full((b.num_rows, total), NOT_LISTED, "<u2"), np.empty(b.num_rows, object)
            for mine, x in _matrices(b.column(2)):
                for k, row in zip(mine, x):
                    v[k] = row.tobytes()
                if x.shape[1] not in centroids:
                    continue
                c, at = centroids[x.shape[1]], first[x.shape[1]]
                reach = np.array([widest.get(at + k, 0.0) for k in range(len(c))])
                f = x.astype(np.float64)
                bound = np.sqrt((f * f).sum(1, keepdims=True)) * np.cos(np.maximum(0.0, _angles(f, c) - reach))
                levels[mine, at:at + len(c)] = np.clip((bound / max(top, 1e-300) + 1) / 2 * BINS, 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary()), pa.array([row.tobytes() for row in levels], pa.binary())],
                                             ["id", "label", "v", "levels"])

    return run


def _edge(level: int, top: float) -> float:
    """No candidate below this level of a list has a greater bound."""
    return (2 * level / BINS - 1) * top + SLACK * top


class _Walk:
    """Rounds over the lists; all that the driver holds are histograms of the lists and the numbers of open members per block."""

    def __init__(self, anchors: DataFrame, lists: DataFrame, widest: dict[int, tuple[float, int]], top: float):
        self.lists, self.top, self.spark = lists, top, anchors.sparkSession
        self.blocks = {c: -(-n // BLOCK) for c, (_, n) in widest.items()}
        counts = lists.select("levels").mapInArrow(_histogram, "cluster int, level int, n bigint").groupBy("cluster", "level").agg(F.sum("n").alias("n"))
        self.many = {c: np.zeros(BINS, np.int64) for c in widest}
        for r in counts.collect():  # at most BINS rows for each of at most MAX_CLUSTERS lists
            if r["cluster"] in self.many:
                self.many[r["cluster"]][r["level"]] = r["n"]

    def run(self, members: DataFrame, depth: int, share: tuple[int, int] | None) -> DataFrame:
        """Rows (key, slot, score, other): every member's first ``depth`` candidates, of its label (slot 0) or, with ``share``, for each
        score it asks for (slots from 1) of other labels."""
        blocks = F.create_map(*[F.lit(x) for c, n in self.blocks.items() for x in (c, n)]) if self.blocks else None
        if blocks is None:
            return self.spark.createDataFrame([], "key bigint, slot int, score bigint, other bigint")
        members = members.select("key", "id", "label", "length", "v", "cluster", "asks", F.pmod(F.xxhash64("key"), blocks[F.col("cluster")]).cast("int").alias("block"))
        walked = {c: BINS for c in self.many}
        found = None
        while True:
            state = members.withColumn("finds", F.expr("cast(array() as array<struct<slot: int, score: bigint, other: bigint>>)"))
            if found is not None:
                state = members.join(found.groupBy("key").agg(F.collect_list(F.struct("slot", "score", "other")).alias("f")), "key", "left").withColumn(
                    "finds", F.coalesce("f", F.expr("cast(array() as array<struct<slot: int, score: bigint, other: bigint>>)"))).drop("f")
            rest = {c: (_edge(at, self.top) if self.many[c][:at].any() else -math.inf) for c, at in walked.items()}
            opened = state.mapInArrow(_open(rest, depth, share), state.schema)
            left = opened.groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n")).collect()
            if not left:
                return found if found is not None else self.spark.createDataFrame([], "key bigint, slot int, score bigint, other bigint")
            stretches: dict[int, tuple[int, int, int, list[int]]] = {}
            for c in sorted({r["cluster"] for r in left}):
                done = int(self.many[c][walked[c]:].sum())
                below = np.cumsum(self.many[c][:walked[c]][::-1])
                low = walked[c] - 1 - min(int(np.searchsorted(below, max(LIST_ROWS, (GROWTH - 1) * done))), len(below) - 1)
                rows = int(self.many[c][low:walked[c]].sum())
                stretches[c] = (low, walked[c], max(1, -(-rows // LIST_ROWS)), sorted(r["block"] for r in left if r["cluster"] == c))
                walked[c] = low
            parts = F.create_map(*[F.lit(x) for c, s in stretches.items() for x in (c, s[2])])
            dealt = opened.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("cluster")] - 1)))
            stretch = self.lists.mapInArrow(_stretch(stretches), "cluster int, block int, part int, level int, other bigint, other_label string, w binary")
            by = ["cluster", "block", "part"]
            finds = dealt.groupBy(*by).cogroup(stretch.groupBy(*by)).applyInArrow(_walked(self.top, depth, share), "key bigint, slot int, score bigint, other bigint")
            first = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "other")
            every = finds if found is None else found.unionByName(finds)
            new = keep(every.withColumn("r", F.row_number().over(first)).where(F.col("r") <= depth).drop("r"))
            if found is not None:
                drop(found)
            found = new


def _histogram(batches):
    total = None
    for b in batches:
        if not b.num_rows:
            continue
        levels = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2").reshape(b.num_rows, -1)
        total = np.zeros((levels.shape[1], BINS), np.int64) if total is None else total
        for c in range(levels.shape[1]):
            total[c] += np.bincount(levels[levels[:, c] != NOT_LISTED, c], minlength=BINS)
    if total is not None:
        c, level = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(total[c, level])], ["cluster", "level", "n"])


def _stretch(stretches: dict[int, tuple[int, int, int, list[int]]]):
    """The candidates of each list's stretch, once per open member block; a list's part is dealt by position, so that no id is hot."""

    def run(batches):
        at = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            levels = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u2").reshape(b.num_rows, -1)
            number = at + np.arange(b.num_rows)
            at += b.num_rows
            for c, (low, high, parts, blocks) in stretches.items():
                mine = np.flatnonzero((levels[:, c] >= low) & (levels[:, c] < high))
                if not len(mine):
                    continue
                take = pa.array(mine)
                cols = [pa.array((number[mine] % parts).astype(np.int32)), pa.array(levels[mine, c].astype(np.int32)), *(b.column(k).take(take) for k in range(3))]
                for block in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), c, np.int32)), pa.array(np.full(len(mine), block, np.int32)), *cols],
                                                     ["cluster", "block", "part", "level", "other", "other_label", "w"])

    return run


def _open(rest: dict[int, float], depth: int, share: tuple[int, int] | None):
    """Members whose lists can still hold a better find."""

    def run(batches):
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in ("cluster", "length", "asks", "finds")}
            keep_ = []
            for cluster, length, asks, finds in zip(*(col[n].to_pylist() for n in ("cluster", "length", "asks", "finds"))):
                goals = _goals(asks, share)
                tops = [sorted((f["score"] for f in finds if f["slot"] == slot), reverse=True) for slot, _, _ in goals]
                keep_.append(_least(goals, tops, depth) <= length * rest[cluster] if rest[cluster] > -math.inf else False)
            yield b.filter(pa.array(keep_, pa.bool_()))

    return run


def _goals(asks: list[int], share: tuple[int, int] | None) -> list[tuple[int, float, float]]:
    """(slot, least score, greatest score) that a member looks for."""
    if share is None:
        return [(0, -math.inf, math.inf)]
    return [(k + 1, -(-share[0] * s // 100), share[1] * s // 100) for k, s in enumerate(asks)]


def _least(goals, tops, depth: int) -> float:
    """The least score that would still count for a member: candidates that can't reach it are of no use."""
    return min((math.inf if low > high else max(low, top[depth - 1]) if len(top) >= depth else low for (_, low, high), top in zip(goals, tops)), default=math.inf)


def _walked(top: float, depth: int, share: tuple[int, int] | None):
    """A block of members down one part of their list, by falling bound, each until nothing below can count for it."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            out = _down(left, right, top, depth, share)
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["key", "slot", "score", "other"])

    return run


def _down(left: pa.Table, right: pa.Table, top: float, depth: int, share) -> list[tuple[int, int, int, int]]:
    member = left.select(["key", "id", "label", "length", "asks", "finds"]).to_pylist()
    order = np.argsort(-right["level"].to_numpy(), kind="stable")
    right = right.take(pa.array(order))
    dim = len(left["v"][0].as_py()) // 8
    u = np.frombuffer(b"".join(left["v"].to_pylist()), np.int64).reshape(left.num_rows, dim)
    w = np.frombuffer(b"".join(right["w"].to_pylist()), np.int64).reshape(right.num_rows, dim)
    level, other = right["level"].to_numpy(), right["other"].to_numpy()
    names: dict[str, int] = {}
    label = np.array([names.setdefault(x, len(names)) for x in right["other_label"].to_pylist()])
    longest = max(m["length"] for m in member) * min(top, math.sqrt((w.astype(np.float64) ** 2).sum(1).max()))
    kind = np.float64 if longest < 2.0 ** 52 else np.int64  # in doubles the sums are exact below 2^53
    uk, wk = u.astype(kind), w.astype(kind)
    goals = [_goals(m["asks"], share) for m in member]
    tops = [[sorted((f["score"] for f in m["finds"] if f["slot"] == slot), reverse=True)[:depth] for slot, _, _ in g] for m, g in zip(member, goals)]
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in g] for g in goals]
    least = np.array([_least(g, t, depth) for g, t in zip(goals, tops)])
    length = np.array([m["length"] for m in member])
    for a in range(0, len(w), STEP):
        still = np.flatnonzero(least <= length * _edge(int(level[a]) + 1, top))
        if not len(still):
            break
        score = (uk[still] @ wk[a:a + STEP].T).astype(np.int64)
        for k, s in zip(still, score):
            m = member[k]
            same = label[a:a + STEP] == names.get(m["label"], -1)
            fit = np.flatnonzero((same if share is None else ~same) & (s >= least[k]))
            if share is None:
                fit = fit[~((other[a + fit] == m["id"]) & (w[a + fit] == u[k]).all(1))]
            for j, (_, low, high) in enumerate(goals[k]):
                best = tops[k][j]
                bar = max(low, best[depth - 1]) if len(best) >= depth else low
                mine = fit[(s[fit] >= bar) & (s[fit] <= high)]
                if len(mine):
                    found[k][j] = sorted(found[k][j] + list(zip((-s[mine]).tolist(), other[a + mine].tolist())))[:depth]
                    tops[k][j] = sorted(best + s[mine].tolist(), reverse=True)[:depth]
            least[k] = _least(goals[k], tops[k], depth)
    return [(m["key"], slot, -s, o) for m, g, f in zip(member, goals, found) for (slot, _, _), best in zip(g, f) for s, o in best]
