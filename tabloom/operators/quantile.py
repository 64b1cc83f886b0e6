"""Exact quantiles in two scans, at any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer, so a global median over
billions of distinct doubles lands in one task. Here

1. one aggregate over all columns takes count, extremes and a mergeable quantile sketch (``percentile_approx``,
   whose ranks are off by at most 1 / ``ACCURACY`` of the rows), which brackets every wanted order statistic;
2. one pass over all columns counts the rows below each bracket, and each value inside it: a few rows in ten thousand,
   written as a table (bracket, value, count).

The rest works on that table: it is dealt by range of value, the ranges' counts are added up, and only the range that
holds a wanted rank is put in order. The counts prove the bracket; one that does not hold its ranks (rounding of the sketch)
is taken over the whole column instead. The driver sees counts of ranges and one value per order statistic.
Quantiles interpolate linearly between neighbouring order statistics, like NumPy/pandas and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

ACCURACY = 20_000
RANGE_ROWS = 1 << 16  # values put in order at a time, about


def _positions(n: int, p: float) -> tuple[int, int, float]:
    pos = (n - 1) * p
    lo = math.floor(pos)
    return lo + 1, min(lo + 2, n), pos - lo


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def exact_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]],
                    counts: Mapping[str, tuple[int, float, float]] | None = None) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles of each column (NULLs ignored). ``counts``: (non-null count, min, max) of
    columns for which the caller knows them; those without two different values need no scan."""
    counts = dict(counts or {})
    cols = [c for c in probs if c not in counts or (counts[c][0] and counts[c][1] != counts[c][2])]
    asked = {c: sorted(set(probs[c])) for c in cols}
    slack = 4.0 / ACCURACY
    brackets: dict[str, list[tuple[float, float]]] = {}
    if cols:
        aggs = []
        for i, c in enumerate(cols):
            near = [min(1.0, max(0.0, p + s)) for p in asked[c] for s in (-slack, slack)]
            aggs += [F.count(_x(c)).alias(f"n{i}"), F.min(_x(c)).alias(f"a{i}"), F.max(_x(c)).alias(f"b{i}"), F.percentile_approx(_x(c), near, ACCURACY).alias(f"q{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(cols):
            n, low, high = row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]
            counts[c] = (n, low, high)
            # among few rows, a neighbour in rank may lie outside: the column is its own bracket
            whole = n * slack < 4
            brackets[c] = [(low, high) if whole else (row[f"q{i}"][2 * k], row[f"q{i}"][2 * k + 1]) for k in range(len(asked[c]))] if n else []
    wanted: dict[tuple[str, int], tuple[float, float]] = {}
    for c in cols:
        n, low, high = counts[c]
        if n and low != high:
            for p, bracket in zip(asked[c], brackets[c]):
                for k in _positions(n, p)[:2]:
                    wanted.setdefault((c, k), bracket)
    found = _order_statistics(df, wanted)
    if missed := {t: counts[t[0]][1:] for t in wanted if t not in found}:
        found |= _order_statistics(df, missed)
    out: dict[tuple[str, float], float | None] = {}
    for c in probs:
        n, low, high = counts[c]
        for p in probs[c]:
            if not n:
                out[c, p] = None
                continue
            a, b, frac = _positions(n, p)
            xa, xb = (float(low), float(low)) if low == high else (found[c, a], found[c, b])
            out[c, p] = xa if frac == 0 or xa == xb else xa + (xb - xa) * frac
    return out


def _order_statistics(df: DataFrame, wanted: Mapping[tuple[str, int], tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The k-th smallest values of columns, for each (column, k) whose bracket holds it. One scan of ``df``."""
    if not wanted:
        return {}
    places = {b: i for i, b in enumerate(dict.fromkeys((c, *bracket) for (c, _), bracket in wanted.items()))}
    entries = []
    for (c, low, high), i in places.items():
        x = _x(c)
        inside = F.struct(F.lit(i).alias("t"), F.when(x >= F.lit(float(low)), x).alias("x"))  # below the bracket: counted without a value
        entries.append(F.when(x <= F.lit(float(high)), inside))
    values = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).groupBy("e.t", "e.x").agg(F.count(F.lit(1)).alias("n"))
    table = cut_lineage(values)
    rows = table.count()
    parts = max(1, min(-(-rows // RANGE_ROWS), 1 << 14))
    dealt = cut_lineage(table.repartitionByRange(parts, "t", F.col("x").asc_nulls_first()).withColumn("part", F.spark_partition_id())) if parts > 1 else table.withColumn("part", F.lit(0))
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in dealt.groupBy("t", "part").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("below")).collect():
        sums.setdefault(r["t"], {})[r["part"]] = (r["n"], r["below"])
    needs = []
    for (c, k), bracket in wanted.items():
        t, before = places[(c, *bracket)], 0
        if sum(below for _, below in sums.get(t, {}).values()) >= k:
            continue  # the bracket begins above this rank
        for part in sorted(sums.get(t, {})):
            if k <= before + sums[t][part][0]:
                needs.append((t, part, c, k, k - before))
                break
            before += sums[t][part][0]
    if not needs:
        return {}
    need = F.broadcast(df.sparkSession.createDataFrame(needs, "t int, part int, c string, k bigint, rank bigint"))
    upto = F.sum("n").over(Window.partitionBy("t", "part").orderBy(F.col("x").asc_nulls_first()))
    hit = dealt.join(need.select("t", "part").distinct(), ["t", "part"], "left_semi").withColumn("upto", upto).join(need, ["t", "part"]).where(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return {(r["c"], r["k"]): r["x"] for r in hit.select("c", "k", "x").collect()}
