"""Exact cuts of a sort order at given ranks, without sorting or shuffling the table.

Where does the row of rank r stand, in the order of some BIGINT keys and then some tie columns? The keys' range is
divided into bins, one aggregate counts the rows of each bin, and only the bins that hold a cut are divided again. What is
left is a range with at most ``ORDER_ROWS`` rows, or a single value of all keys. Only those rows, with
no columns but keys and ties, are put in order, and the row at the cut is the boundary. A value that very many rows share (one key
on a third of the table) is counted by its tie columns first and ordered by ranges of them. The driver sees the
histograms of the open ranges (at most ``BINS`` bins of all) and one boundary per cut.

``Cuts.passed`` then is a projection of the table: the number of cuts that a row lies behind, from comparing its
keys with the boundaries. Tie columns are compared only if rows of equal keys lie on both sides of a cut. Rows
that agree in keys and ties are interchangeable; where a cut falls among them, the table is written once with a row number
(it must not change between the count and the projection), which then is the last key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tabloom.session import cut_lineage

ORDER_ROWS = 1 << 16
BINS = 1 << 17
LEAST_BINS = 16
FEW_RANGES = 16
TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Key:
    """A sort key: a BIGINT column without nulls, with values in [low, high]; ``high`` may be far above the others."""
    name: str
    low: int
    high: int
    usual: int  # values above it are few or equal (a sentinel), and share the last bin


@dataclass
class _Range:
    group: Any
    fixed: tuple[int, ...]  # values of the keys before the one that is divided
    low: int
    high: int
    usual: int
    rows: int
    needs: list[tuple[int, int]]  # (cut, rank within the range)


@dataclass
class Boundary:
    group: Any
    cut: int
    values: tuple            # of keys and ties
    level: int               # 0: keys tell the sides apart, 1: ties do, 2: neither does
    within: int = 0          # rows equal to the boundary that belong before the cut
    row: int | None = None


@dataclass
class Cuts:
    """Boundaries of a table, by group: ``always`` counts the cuts at rank 0, which every row is behind."""
    table: DataFrame
    keys: list[str]
    ties: list[str]
    group: str | None
    bounds: dict[Any, list[Boundary]]
    always: dict[Any, int]
    level: int
    extras: dict[Any, int] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [*self.keys, *(self.ties if self.level >= 1 else []), *(["_row"] if self.level >= 2 else [])]

    def _value(self, b: Boundary) -> tuple:
        whole = (*b.values, b.row if b.row is not None else TOP)
        names = [*self.keys, *self.ties, "_row"]
        return tuple(whole[names.index(c)] for c in self.columns())

    def passed(self) -> DataFrame:
        """The table with ``_passed``, the number of cuts a row lies behind (and ``_extra``, its group's number given by the caller). A
        projection, with a broadcast of one row per group where there are groups."""
        d = self.table
        single = len(self.columns()) == 1  # the usual case: one number is compared
        own = F.col(self.columns()[0]) if single else F.struct(*[F.col(f"`{c}`") for c in self.columns()])
        kind = StructType([StructField(c, d.schema[c].dataType) for c in self.columns()])
        if self.group is None:
            literals = [[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(self._value(b), kind.fields)] for b in self.bounds.get(None, [])]
            lead = F.col(self.columns()[0])  # keys have no nulls; the columns after the first are compared where it is equal only
            behind = [lead > v[0] if single else (lead > v[0]) | ((lead == v[0]) & (own > F.struct(*v))) for v in literals]
            count = reduce(lambda a, b: a + b.cast("int"), behind, F.lit(self.always.get(None, 0)))
            return d.withColumn("_passed", count).withColumn("_extra", F.lit(self.extras.get(None, 0)).cast("bigint"))
        most = max((len(b) for b in self.bounds.values()), default=0)
        fields = [StructField("_group", d.schema[self.group].dataType), StructField("_always", IntegerType()), StructField("_extra", LongType())]
        fields += [StructField(f"_bound{k}", kind) for k in range(most)]
        rows = [(g, n, self.extras.get(g, 0), *[self._value(b) for b in self.bounds.get(g, [])], *[None] * (most - len(self.bounds.get(g, [])))) for g, n in self.always.items()]
        bounds = F.broadcast(d.sparkSession.createDataFrame(rows, StructType(fields)))
        behind = [F.coalesce(own > F.col(f"_bound{k}.`{self.columns()[0]}`" if single else f"_bound{k}"), F.lit(False)).cast("int") for k in range(most)]
        joined = d.join(bounds, d[f"`{self.group}`"].eqNullSafe(bounds["_group"]))
        return joined.withColumn("_passed", reduce(lambda a, b: a + b, behind, F.col("_always"))).drop("_group", "_always", *[f"_bound{k}" for k in range(most)])


def find_cuts(df: DataFrame, keys: Sequence[Key], ties: Sequence[str], ranks: dict[Any, Sequence[int]], sizes: dict[Any, int],
              group: str | None = None, extras: dict[Any, int] | None = None) -> Cuts:
    """The boundaries of ``df`` behind its first r rows, for each r in ``ranks`` of a group, in the order of keys, then ties. ``sizes``: rows per
    group. Without ``group`` the only group is None."""
    names, ties = [k.name for k in keys], list(ties)
    open_: dict[Any, list[tuple[int, int]]] = {}
    always = {}
    for g, n in sizes.items():
        wanted = list(ranks.get(g, []))
        always[g] = sum(r <= 0 for r in wanted)
        if inside := [(k, r) for k, r in enumerate(wanted) if 0 < r < n]:
            open_[g] = inside
    narrow = df.select((F.col(f"`{group}`") if group else F.lit(None).cast("int")).alias("_g"), *[F.col(f"`{c}`") for c in dict.fromkeys([*names, *ties])])
    found = _select(narrow, keys, ties, [_Range(g, (), keys[0].low, keys[0].high, keys[0].usual, sizes[g], needs) for g, needs in open_.items()])
    level = max((b.level for b in found), default=0)
    if level == 2:  # the cut falls among equal rows: give them numbers, in a table that stays as it is
        df = cut_lineage(df.drop("_row").withColumn("_row", F.monotonically_increasing_id()))
        top = df.agg(F.max("_row")).first()[0]
        number = [Key("_row", 0, top, top)]
        for b in found:
            if b.level == 2:
                same = [F.col(f"`{c}`").eqNullSafe(F.lit(v).cast(df.schema[c].dataType)) for c, v in zip([*names, *ties], b.values)]
                if group:
                    same.append(F.col(f"`{group}`").eqNullSafe(F.lit(b.group).cast(df.schema[group].dataType)))
                equal = df.where(reduce(lambda x, y: x & y, same)).select(F.lit(None).cast("int").alias("_g"), "_row")
                b.row = _select(equal, number, [], [_Range(None, (), 0, top, top, ORDER_ROWS + 1, [(0, b.within)])])[0].values[0]
    bounds: dict[Any, list[Boundary]] = {}
    for b in sorted(found, key=lambda b: b.cut):
        bounds.setdefault(b.group, []).append(b)
    return Cuts(df, names, ties, group, bounds, always, level, extras or {})


def _ranges_table(narrow: DataFrame, ranges: list[_Range], depth: int, more: list[tuple] | None = None) -> DataFrame:
    """The open ranges as a small table to join the rows with: (_id, _group, _fixed0.., _low, _high, _last, _width)."""
    spark = narrow.sparkSession
    fields = [StructField("_id", IntegerType()), StructField("_group", narrow.schema["_g"].dataType)] + [StructField(f"_fixed{k}", LongType()) for k in range(depth)]
    fields += [StructField(c, LongType()) for c in ("_low", "_high", "_last", "_width")]
    rows = [(k, r.group, *r.fixed, r.low, r.high, *(more[k] if more else (r.high, 1))) for k, r in enumerate(ranges)]
    return F.broadcast(spark.createDataFrame(rows, StructType(fields)))


def _within(narrow: DataFrame, ranges: list[_Range], table: DataFrame, names: list[str], depth: int) -> DataFrame:
    leading = names[:depth + 1] if depth + 1 < len(names) else names[:depth]
    if leading and len(ranges) <= FEW_RANGES:  # compared before the last key (a hash of columns) is worked out for rows outside
        keys = [F.col(f"`{c}`") for c in leading]
        inside = [reduce(lambda a, b: a & b, [*[k == F.lit(v) for k, v in zip(keys, r.fixed)], *[k.between(r.low, r.high) for k in keys[depth:]]]) for r in ranges]
        narrow = narrow.where(reduce(lambda a, b: a | b, inside))
    on = [narrow["_g"].eqNullSafe(table["_group"])] + [narrow[f"`{names[k]}`"] == table[f"_fixed{k}"] for k in range(depth)]
    x = narrow[f"`{names[depth]}`"]
    return narrow.join(table, reduce(lambda a, b: a & b, [*on, x >= table["_low"], x <= table["_high"]]))


def _select(narrow: DataFrame, keys: Sequence[Key], ties: list[str], ranges: list[_Range]) -> list[Boundary]:
    """Boundaries of the cuts that the ranges need."""
    names, out = [k.name for k in keys], []
    small: list[list[_Range]] = [[] for _ in keys]  # by the key that is divided
    single: list[_Range] = []
    depth = 0
    while depth < len(keys):
        for r in ranges:
            if r.rows <= ORDER_ROWS:
                small[depth].append(r)
        todo = [r for r in ranges if r.rows > ORDER_ROWS]
        done = [r for r in todo if r.low == r.high]
        todo = [r for r in todo if r.low < r.high]
        if todo:
            bins = max(LEAST_BINS, min(1 << 14, BINS // len(todo)))
            layout = []
            for r in todo:
                width = max(1, -(-(min(r.usual, r.high) - r.low + 1) // (bins - 1)))
                layout.append((min(r.low + width * (bins - 1), r.high + 1, TOP), width))
            rows = _within(narrow, todo, _ranges_table(narrow, todo, depth, layout), names, depth)
            x = F.col(f"`{names[depth]}`")
            spot = F.when(x >= F.col("_last"), F.lit(bins - 1).cast("bigint")).otherwise(F.expr(f"(`{names[depth]}` - _low) div _width"))
            counts: list[dict[int, int]] = [{} for _ in todo]
            for c in rows.groupBy("_id", spot.alias("_bin")).agg(F.count(F.lit(1)).alias("_n")).collect():  # at most ``BINS`` rows, or LEAST_BINS a range
                counts[c["_id"]][c["_bin"]] = c["_n"]
            ranges = [r for r in done]
            for r, (last, width), count in zip(todo, layout, counts):
                ranges += _halved(r, last, width, bins, count)
            continue
        if depth + 1 == len(keys):
            single = done
        else:
            nxt = keys[depth + 1]
            ranges = [_Range(r.group, (*r.fixed, r.low), nxt.low, nxt.high, nxt.usual, r.rows, r.needs) for r in done]
        depth += 1
    for k, part in enumerate(small):
        if part:
            out += _ordered(narrow, part, names, ties, k)
    if single:
        out += _counted(narrow, single, names, ties)
    return out


def _halved(r: _Range, last: int, width: int, bins: int, count: dict[int, int]) -> list[_Range]:
    """The bins of a range that hold its cuts."""
    out: dict[int, _Range] = {}
    before, needs = 0, sorted(r.needs, key=lambda x: x[1])
    for b in sorted(count):
        while needs and needs[0][1] <= before + count[b]:
            cut, rank = needs.pop(0)
            if b not in out:
                low, high = (last, r.high) if b == bins - 1 else (r.low + b * width, min(r.low + (b + 1) * width - 1, last - 1))
                out[b] = _Range(r.group, r.fixed, low, high, r.usual if r.usual > low else high, count[b], [])
            out[b].needs.append((cut, rank - before))
        before += count[b]
    return list(out.values())


def _needs_table(narrow: DataFrame, ranges: list[_Range]) -> DataFrame:
    rows = [(k, cut, rank) for k, r in enumerate(ranges) for cut, rank in r.needs]
    return F.broadcast(narrow.sparkSession.createDataFrame(rows, "_id int, _cut int, _rank bigint"))


def _ordered(narrow: DataFrame, ranges: list[_Range], names: list[str], ties: list[str], depth: int) -> list[Boundary]:
    """Boundaries in ranges of at most ORDER_ROWS rows, which are put in order, a range by itself."""
    whole = [F.col(f"`{c}`") for c in [*names, *ties]]
    rows = _within(narrow, ranges, _ranges_table(narrow, ranges, depth), names, depth).select("_id", *whole)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy(*whole)))
    for n, at, many in ((len(names), "_key_place", "_key_rows"), (len(whole), "_equal_place", "_equal_rows")):  # the row's place among those with its keys, and among its equals
        same = Window.partitionBy("_id", *whole[:n])
        rows = rows.withColumns({at: F.col("_r") - F.min("_r").over(same) + 1, many: F.count(F.lit(1)).over(same)})
    needs = _needs_table(narrow, ranges)
    hit = rows.join(needs, (rows["_id"] == needs["_id"]) & (rows["_r"] == needs["_rank"])).select(rows["_id"], "_cut", *whole, "_key_place", "_key_rows", "_equal_place", "_equal_rows")
    return [_boundary(ranges[r["_id"]].group, r["_cut"], [r[c] for c in [*names, *ties]], r["_key_place"], r["_key_rows"], r["_equal_place"], r["_equal_rows"]) for r in hit.collect()]


def _boundary(group, cut: int, values: list, k: int, kn: int, t: int, tn: int) -> Boundary:
    return Boundary(group, cut, tuple(values), 0 if k == kn else 1 if t == tn else 2, t)


def _counted(narrow: DataFrame, ranges: list[_Range], names: list[str], ties: list[str]) -> list[Boundary]:
    """Boundaries among very many rows of equal keys: the tie columns' distinct values with their counts, dealt by range of
    them, so that each task orders a part."""
    depth = len(names) - 1
    tie = [F.col(f"`{c}`") for c in ties]
    rows = _within(narrow, ranges, _ranges_table(narrow, ranges, depth), names, depth).groupBy("_id", *tie).agg(F.count(F.lit(1)).alias("_n"))
    parts = max(8, -(-sum(r.rows for r in ranges) // ORDER_ROWS))
    dealt = cut_lineage(rows.repartitionByRange(min(parts, 1 << 14), "_id", *tie).withColumn("_part", F.spark_partition_id()))
    sums: dict[int, dict[int, int]] = {}
    for s in dealt.groupBy("_id", "_part").agg(F.sum("_n").alias("_n")).collect():
        sums.setdefault(s["_id"], {})[s["_part"]] = s["_n"]
    wanted = []
    for k, r in enumerate(ranges):
        for cut, rank in r.needs:
            before = 0
            for part in sorted(sums[k]):
                if rank <= before + sums[k][part]:
                    wanted.append((k, cut, rank, part, before))
                    break
                before += sums[k][part]
    needs = F.broadcast(narrow.sparkSession.createDataFrame(wanted, "_id int, _cut int, _rank bigint, _part int, _before bigint"))
    upto = F.sum("_n").over(Window.partitionBy("_id", "_part").orderBy(*tie or [F.lit(0)]))
    some = dealt.join(needs.select("_id", "_part").distinct(), ["_id", "_part"], "left_semi").withColumn("_upto", upto)
    hit = some.join(needs, ["_id", "_part"]).where((F.col("_rank") - F.col("_before") <= F.col("_upto")) & (F.col("_rank") - F.col("_before") > F.col("_upto") - F.col("_n")))
    out = []
    for r in hit.collect():
        own = ranges[r["_id"]]
        values = [*own.fixed, own.low, *[r[c] for c in ties]]
        within = r["_rank"] - r["_before"] - (r["_upto"] - r["_n"])
        out.append(_boundary(own.group, r["_cut"], values, r["_rank"], own.rows, within, r["_n"]))
    return out
