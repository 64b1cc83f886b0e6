"""Near-duplicate embeddings: an exact metric range join.

Unit vectors with cosine >= t lie within r = sqrt(2 - 2 t) of each other. Identical vectors
of a label are one class first. Pivots, a bounded number of vectors, partition the classes:
each belongs to the cell of its nearest pivot. By the triangle inequality a vector can only
have a partner in another pivot's cell if its distance to the boundary between the two
pivots, (v.p - v.q) / |p - q|, is at most r; it is replicated to those cells. Cells join
independently; a cell with many vectors is joined in blocks of bounded size. A block
reports, per vector of its own, the number of linked vectors, and a spanning forest of its
links, so the output grows with the vectors and not with the links.

Only vectors of one label (and one dimension) are compared. Null or zero vectors, vectors
with a null or non-finite component and rows with a null label or id link with nothing; a
row with a null id has no component and is not kept. Every row counts as a vector, repeated
rows too; rows that share an id but not their vector are vectors of their own, each with its own links. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut_lineage, ship
from tabloom.llm.components import connected_components

CELL_ROWS = 4096
MAX_PIVOTS = 256
BLOCK = 2048
SLACK = 1e-9  # replication is generous by this much; the links themselves are exact


def range_join(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").drop("usable")
    # a class has a number of its own: ids may stand on several different vectors
    classes = cut_lineage(good.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    pivots = min(MAX_PIVOTS, -(-n // CELL_ROWS))
    chosen = classes.select("v", "label", F.xxhash64("low").alias("h")).orderBy("h", "label", "v").limit(pivots).collect()
    links = cut_lineage(_linked(classes, [r["v"] for r in chosen], cosine))
    per_class = links.groupBy("rep").agg(F.sum("n").alias("n"))
    component = connected_components(links.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = classes.join(per_class, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "v", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    known = placed.join(least, "component").select("label", "v", "n_links", "component_id")
    found = good.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(classes: DataFrame, pivots: list[list[float]], cosine: float) -> DataFrame:
    """Rows (rep, n, root): partial counts of linked vectors, or with ``root`` an edge of a spanning forest."""
    spark = classes.sparkSession
    by_dim: dict[int, np.ndarray] = {}
    for p in pivots:
        by_dim.setdefault(len(p), []).append(_unit(np.array([p]))[0])
    by_dim = {d: np.array(p) for d, p in by_dim.items()}
    shared = spark.sparkContext.broadcast(by_dim)  # at most MAX_PIVOTS vectors
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK

    def cells(batches):
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            data = batch.column(1)
            size = np.diff(data.offsets.to_numpy())
            flat = data.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            out = []
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                unit = _unit(flat[(at[mine][:, None] + np.arange(d))])
                p = shared.value.get(int(d))
                if p is None:
                    out.append((mine, np.zeros(len(mine), int), np.ones(len(mine), bool)))
                    continue
                near = unit @ p.T
                home = near.argmax(1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                inside = near[np.arange(len(mine)), home][:, None] - near <= reach * gap[home] + SLACK
                inside[np.arange(len(mine)), home] = True
                r, c = np.nonzero(inside)
                out.append((mine[r], c, home[r] == c))
            row, cell, home = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(reps[row]), pa.array(cell.astype(np.int32)), pa.array(home)], ["rep", "cell", "home"])

    where = classes.select("rep", "v").mapInArrow(cells, "rep bigint, cell int, home boolean")
    spread = cut_lineage(where.join(classes.select("rep", "label", "copies", "v"), "rep").withColumn("dim", F.size("v")))
    cell = ["label", "dim", "cell"]
    sizes = spread.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("chunks"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("chunks > 0")
    spread = spread.join(sizes, cell)
    part = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = spread.where("home").select(*cell, part("chunk", "chunks").alias("chunk"), each("blocks").alias("block"), "rep", "copies", "v", F.lit(True).alias("own"))
    others = spread.select(*cell, each("chunks").alias("chunk"), part("block", "blocks").alias("block"), "rep", "copies", "v", F.lit(False).alias("own"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, them = pdf[pdf["own"]], pdf[~pdf["own"]]
        if not len(mine) or not len(them):
            return pd.DataFrame({"rep": [], "n": [], "root": []})
        a, b = mine["rep"].to_numpy(np.int64), them["rep"].to_numpy(np.int64)
        u, w = np.stack(mine["v"].to_numpy()), np.stack(them["v"].to_numpy())
        u, w = u / np.abs(u).max(1)[:, None], w / np.abs(w).max(1)[:, None]
        link = (u @ w.T) / (np.sqrt((u * u).sum(1))[:, None] * np.sqrt((w * w).sum(1))) >= cosine
        link &= a[:, None] != b
        count = link @ them["copies"].to_numpy(np.int64)
        i, j = np.nonzero(link)
        nodes, back = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        x, y, low = back[:len(i)], back[len(i):], np.arange(len(nodes))
        while True:  # labels of the block's own components
            new = low.copy()
            np.minimum.at(new, x, low[y])
            np.minimum.at(new, y, new[x])
            new = new[new]
            if (new == low).all():
                break
            low = new
        moved = low < np.arange(len(nodes))
        return pd.concat([pd.DataFrame({"rep": a[count > 0], "n": count[count > 0], "root": None}),
                          pd.DataFrame({"rep": nodes[moved], "n": 0, "root": nodes[low[moved]]})]).astype({"root": "Int64"})

    return own.unionByName(others).groupBy(*cell, "chunk", "block").applyInPandas(join, "rep bigint, n bigint, root bigint")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]
