"""Fitted feature preparation.

``FeaturePreparer(plan).fit(train)`` computes everything a transform needs from the
training rows only:

* one value-table aggregate over the categorical features: encoder levels (sorted) and most-frequent fills. Features
  with at most ``MAX_LEVELS`` levels are fetched; the levels of larger ones stay a table, numbered by their distributed order;
* one grouped count per frequency source, written once as a table (the map);
* one aggregate over the numeric outputs (count, non-null count, mean, population
  variance, min, max), plus exact quantiles for median fills and robust scaling.
  Scaler statistics are those of the *imputed* column, combined algebraically from
  the non-null statistics and the fill value (robust scaling of an imputed column
  takes one extra quantile run on the filled expression).

``PreparedFeatures.transform(df)`` is one projection: numeric rules, date parts,
alignment of missing columns to NULL, fills, scaling and encoding are literal
expressions inside whole-stage codegen; beyond ``INLINE_LEVELS`` levels a feature's
codes come from a join with its level table. Frequency maps and level tables are joined, broadcast only
when their row count (known from the fit) is under ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.dates import date_part_columns, lenient_timestamp
from tabloom.functions.transforms import apply_rules
from tabloom.operators.profile import is_numeric_type
from tabloom.operators.quantile import exact_quantiles
from tabloom.plans import overrides as ov
from tabloom.plans.feature_plan import FeaturePlan

MAX_LEVELS = 10_000      # levels fetched, and one-hot columns by name, per feature
INLINE_LEVELS = 64       # codes as literal expressions
BROADCAST_ROWS = 1_000_000
NULL_LEVEL = "null"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class PreparedFeatures:
    plan: FeaturePlan
    fills: dict[str, Any] = field(default_factory=dict)
    scalers: dict[str, tuple[float, float]] = field(default_factory=dict)  # col -> (center, scale)
    categories: dict[str, list] = field(default_factory=dict)
    freq_maps: dict[str, DataFrame] = field(default_factory=dict)
    freq_sizes: dict[str, int] = field(default_factory=dict)
    raw_types: dict[str, str] = field(default_factory=dict)
    level_tables: dict[str, DataFrame] = field(default_factory=dict)  # of features with more than MAX_LEVELS levels: (level, index)
    level_sizes: dict[str, int] = field(default_factory=dict)

    # ---- levels -----------------------------------------------------------------------
    def levels_of(self, c: str) -> int:
        return self.level_sizes.get(c, len(self.categories.get(c, [])))

    def joined(self) -> set[str]:
        """Ordinal features whose codes come from a join."""
        return {c for c in self.plan.raw_categorical_features if self.plan.encoding.get(c) == "ordinal" and self.levels_of(c) > INLINE_LEVELS}

    def _with_index(self, pre: DataFrame, c: str) -> DataFrame:
        """``pre`` with ``_ix_c``: the number of the row's level, or the number of levels if it is none of them. The typed value is
        joined; the level table is broadcast under a row bound, else the join is Spark's, which splits a level that very many rows have."""
        kind, spark = self.raw_types.get(c, "string"), pre.sparkSession
        x = _c(c)
        if c in self.fills:
            x = F.coalesce(x, F.lit(self.fills[c]).cast(kind))
        if c in self.level_tables:
            lv = self.level_tables[c].select(F.col("level").alias("_lv"), F.col("index").alias("_li"))
        else:
            lv = spark.createDataFrame([(v, i) for i, v in enumerate(self.categories[c])], f"`_lv` {kind}, `_li` int")
        lv = F.broadcast(lv) if self.levels_of(c) <= BROADCAST_ROWS else lv
        return (pre.withColumn("_lk", x.cast(kind)).join(lv, F.col("_lk").eqNullSafe(F.col("_lv")), "left")
                .withColumn(f"_ix_{c}", F.coalesce(F.col("_li"), F.lit(self.levels_of(c))).cast("double")).drop("_lk", "_lv", "_li"))

    # ---- stage 1: row-local rules, derived features, date parts, alignment ------------
    def pre_frame(self, df: DataFrame, keep: Sequence[str] = (), keep_prefix: str = "") -> DataFrame:
        return _pre_frame(self.plan, df, self.freq_maps, self.freq_sizes, keep, keep_prefix)

    # ---- stage 2: fills, scaling, encoding ----------------------------------------
    def named_outputs(self) -> list[tuple[str, Column]]:
        """(output name, expression) over the pre-frame, in matrix (C1 block) order."""
        plan, out, joined = self.plan, [], self.joined()
        for block in column_blocks(plan):
            for c in block:
                if c in plan.numeric_features:
                    x = _c(c).cast("double")
                    if c in self.fills:
                        x = F.coalesce(x, F.lit(self.fills[c]).cast("double"))
                    if c in self.scalers:
                        center, scale = self.scalers[c]
                        x = (x - F.lit(center)) / F.lit(scale)
                    out.append((c, x.alias(c)))
                    continue
                x = _c(c)
                if c in self.fills:
                    x = F.coalesce(x, F.lit(self.fills[c]).cast(self.raw_types.get(c, "string")))
                cats = self.categories.get(c, [])
                if c in joined:
                    code = F.when(F.col(f"`_ix_{c}`") >= self.levels_of(c), -1.0).otherwise(F.col(f"`_ix_{c}`"))
                    out.append((c, F.when(x.isNull(), F.lit(None).cast("double")).otherwise(code).alias(c)))
                elif plan.encoding.get(c) == "ordinal":
                    # codes over the non-missing levels; unseen -> -1; missing stays missing
                    code = None
                    for i, v in enumerate([v for v in cats if v is not None]):
                        cond = x == F.lit(v)
                        code = F.when(cond, F.lit(float(i))) if code is None else code.when(cond, F.lit(float(i)))
                    expr = code.otherwise(F.lit(-1.0)) if code is not None else F.lit(-1.0)
                    out.append((c, F.when(x.isNull(), F.lit(None).cast("double")).otherwise(expr).alias(c)))
                else:
                    for v in cats:
                        cond = x.isNull() if v is None else (x == F.lit(v))
                        name = one_hot_name(c, v)
                        out.append((name, F.when(cond, 1.0).otherwise(0.0).alias(name)))
        return out

    def output_expressions(self) -> list[Column]:
        return [e for _, e in self.named_outputs()]

    def output_names(self) -> list[str]:
        names = []
        for block in column_blocks(self.plan):
            for c in block:
                if c in self.plan.numeric_features or self.plan.encoding.get(c) == "ordinal":
                    names.append(c)
                else:
                    names.extend(one_hot_name(c, v) for v in self.categories.get(c, []))
        return names

    def required_columns(self) -> list[str]:
        """Raw input columns the preparation reads."""
        return required_columns(self.plan)

    def transform(self, df: DataFrame, keep: Sequence[str] = (), keep_prefix: str = "",
                  require_columns: bool = False) -> DataFrame:
        """Prepared columns plus passthrough ``keep`` columns (named ``keep_prefix + k``,
        so a passthrough column may share its name with a feature). Missing input
        columns become NULL features (F13), or raise when ``require_columns`` (N2)."""
        if require_columns:
            missing = [c for c in self.required_columns() if c not in df.columns]
            if missing:
                raise ValueError(f"The input is missing required columns: {', '.join(missing)}")
        many = [c for c in self.level_tables if self.plan.encoding.get(c) != "ordinal"]
        if many:
            raise ValueError(f"one-hot columns by name end at {MAX_LEVELS} levels; assemble() gives the vector of {', '.join(many)}")
        pre = self.pre_frame(df, keep, keep_prefix)
        for c in self.joined():
            pre = self._with_index(pre, c)
        return pre.select(*[_c(keep_prefix + k) for k in keep], *self.output_expressions())

    def assemble(self, df: DataFrame, keep: Sequence[str] = (), output_col: str = "features",
                 keep_prefix: str = "") -> DataFrame:
        """Prepared columns into one vector; non-finite values are refused.

        One-hot features are not expanded into columns, however many levels they have:
        the level index comes from a join with the level table, on the typed value, and ``OneHotEncoder`` emits a sparse vector, whose
        extra "unseen" slot is dropped so an unseen value encodes as all zeros."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        plan = self.plan
        wide = {c for c in plan.raw_categorical_features
                if plan.encoding.get(c) != "ordinal" and self.levels_of(c)}
        pre = self.pre_frame(df, keep, keep_prefix)
        keep_cols = [keep_prefix + k for k in keep]
        for c in sorted(wide | self.joined()):
            pre = self._with_index(pre, c)
        exprs, inputs, checks = [], [], []
        by_name = dict(self.named_outputs())
        for block in column_blocks(plan):
            for c in block:
                if c in wide:
                    inputs.append(f"_oh_{c}")
                    continue
                names = [c] if (c in plan.numeric_features or plan.encoding.get(c) == "ordinal") else \
                    [one_hot_name(c, v) for v in self.categories.get(c, [])]
                for n in names:
                    exprs.append(by_name[n])
                    inputs.append(n)
                    checks.append(n)
        cols = [*[_c(k) for k in keep_cols], *exprs, *[F.col(f"`_ix_{c}`") for c in wide]]
        prepared = pre.select(*cols)
        bad = F.lit(False)
        for n in checks:
            x = _c(n)
            bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        guarded = prepared.withColumn("_bad", F.when(bad, F.raise_error(F.lit(
            "prepared features contain missing or infinite values; add an imputation rule for: "
            + ", ".join(checks[:20])))).otherwise(F.lit(False))).drop("_bad")
        if wide:
            for c in wide:
                meta = {"ml_attr": {"type": "nominal", "name": f"_ix_{c}", "num_vals": self.levels_of(c) + 1}}
                guarded = guarded.withColumn(f"_ix_{c}", F.col(f"`_ix_{c}`").alias(f"_ix_{c}", metadata=meta))
            ohe = OneHotEncoder(inputCols=[f"_ix_{c}" for c in wide], outputCols=[f"_oh_{c}" for c in wide],
                                dropLast=True, handleInvalid="error")
            guarded = ohe.fit(guarded).transform(guarded)
        va = VectorAssembler(inputCols=inputs, outputCol=output_col, handleInvalid="error")
        return va.transform(guarded).select(*[_c(k) for k in keep_cols], output_col)

    # ---- S9: persistence --------------------------------------------------------
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        meta = {
            "plan": {k: (list(v) if isinstance(v, tuple) else v) for k, v in self.plan.__dict__.items()},
            "fills": self.fills, "scalers": self.scalers, "categories": self.categories,
            "freq_sizes": self.freq_sizes, "raw_types": self.raw_types, "level_sizes": self.level_sizes,
        }
        spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/meta")
        for src, m in self.freq_maps.items():
            m.write.mode("overwrite").parquet(f"{path}/freq/{_safe(src)}")
        for k, c in enumerate(self.level_sizes):
            self.level_tables[c].write.mode("overwrite").parquet(f"{path}/levels/{k}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PreparedFeatures":
        meta = json.loads(spark.read.parquet(f"{path}/meta").collect()[0]["meta"])
        pl = meta["plan"]
        plan = FeaturePlan(**{k: (tuple(v) if isinstance(v, list) else v) for k, v in pl.items()})
        freq = {src: spark.read.parquet(f"{path}/freq/{_safe(src)}") for src in meta["freq_sizes"]}
        kinds = meta["raw_types"]
        fills = {c: _typed(v, kinds.get(c, "string")) for c, v in meta["fills"].items()}
        levels = {c: [_typed(v, kinds.get(c, "string")) for v in vs] for c, vs in meta["categories"].items()}
        return PreparedFeatures(plan, fills, {k: tuple(v) for k, v in meta["scalers"].items()},
                                levels, freq, meta["freq_sizes"], meta["raw_types"],
                                {c: spark.read.parquet(f"{path}/levels/{k}") for k, c in enumerate(meta["level_sizes"])}, meta["level_sizes"])


def required_columns(plan: FeaturePlan) -> list[str]:
    """Raw input columns the preparation reads."""
    cfg = plan.overrides or ov.empty()
    derived = set(plan.derived_numeric_features)
    parts = {f"{d}__{p}" for d in plan.date_features for p in ("year", "month", "day", "dayofweek")}
    cols = [c for c in plan.numeric_features if c not in derived and c not in parts]
    cols += list(plan.date_features) + list(plan.raw_categorical_features)
    cols += [r["source"] for r in cfg.get(ov.DERIVED, []) if r["kind"] == "frequency_count"]
    return list(dict.fromkeys(cols))


def _typed(value, kind: str):
    """A level or fill as the Python value of a column of type ``kind``; what does not parse stays as it is."""
    if value is None or not isinstance(value, (str, int, float)) or kind == "string":
        return value
    try:
        if kind == "boolean":
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}[str(value).lower()]
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return int(value)
        if kind.startswith("decimal"):
            return Decimal(str(value))
        return float(value) if kind in ("float", "double") else value
    except (KeyError, ValueError, ArithmeticError):
        return value


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def one_hot_name(c: str, v) -> str:
    if v is None:
        return f"{c}={NULL_LEVEL}"
    if v == NULL_LEVEL:
        return f'{c}="{v}"'
    if isinstance(v, bool):
        return f"{c}={str(v).lower()}"
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return f"{c}={v}"


def column_blocks(plan: FeaturePlan) -> list[list[str]]:
    """Numeric then categorical columns grouped by (imputer, scaler/encoder)
    signature, blocks in first-seen order."""
    blocks: dict[tuple, list[str]] = {}
    for c in plan.numeric_features:
        imp = plan.imputation.get(c)
        sig = ("n", f"{imp['strategy']}:{ov.rule_value_text(imp.get('value'))}" if imp else "none", plan.scaling.get(c, "none"))
        blocks.setdefault(sig, []).append(c)
    for c in plan.raw_categorical_features:
        imp = plan.imputation.get(c)
        sig = ("c", plan.encoding.get(c, "one_hot"), imp["strategy"] if imp else "none",
               ov.rule_value_text(imp.get("value")) if imp else "none")
        blocks.setdefault(sig, []).append(c)
    return list(blocks.values())


def _pre_frame(plan: FeaturePlan, df: DataFrame, freq_maps: dict[str, DataFrame], freq_sizes: dict[str, int],
               keep: Sequence[str] = (), keep_prefix: str = "") -> DataFrame:
    cfg = plan.overrides or ov.empty()
    cols = set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    d = df
    # Frequency lookups on the raw source value (joined before the rules change it)
    derived = [r for r in cfg.get(ov.DERIVED, []) if r["kind"] == "frequency_count"]
    for i, r in enumerate(derived):
        src, outc = r["source"], r["output"]
        if src not in cols or src not in freq_maps:
            d = d.withColumn(outc, F.lit(None).cast("double"))
            continue
        m = freq_maps[src].select(F.col("value").alias(f"_fv{i}"), F.col("count").alias(f"_fc{i}"))
        if freq_sizes.get(src, 0) <= BROADCAST_ROWS:
            m = F.broadcast(m)
        d = (d.join(m, _c(src).eqNullSafe(F.col(f"_fv{i}")), "left")
             .withColumn(outc, F.coalesce(F.col(f"_fc{i}"), F.lit(0.0)).cast("double"))
             .drop(f"_fv{i}", f"_fc{i}"))
    # T1-T10 rules in order, chained per column
    rules_by_col: dict[str, list[dict]] = {}
    for r in cfg.get(ov.TRANS, []):
        rules_by_col.setdefault(r["feature"], []).append(r)
    # T11-T13 date parts, F13 alignment
    exprs: list[Column] = [_c(k).alias(keep_prefix + k) for k in keep if k in d.columns]
    for c in plan.numeric_features:
        if c in plan.derived_numeric_features:
            exprs.append(_c(c).cast("double").alias(c) if c in d.columns else F.lit(None).cast("double").alias(c))
            continue
        src_date = next((dcol for dcol in plan.date_features if c.startswith(f"{dcol}__")), None)
        if src_date is not None and c[len(src_date) + 2:] in ("year", "month", "day", "dayofweek"):
            continue
        if c in cols:
            x = apply_rules(_c(c), rules_by_col[c]) if c in rules_by_col else _c(c).try_cast("double")
            exprs.append(x.alias(c))
        else:
            exprs.append(F.lit(None).cast("double").alias(c))
    for dcol in plan.date_features:
        if dcol in cols:
            ts = lenient_timestamp(_c(dcol), types[dcol])
            exprs.extend(date_part_columns(ts, dcol))
        else:
            exprs.extend(F.lit(None).cast("double").alias(f"{dcol}__{p}") for p in ("year", "month", "day", "dayofweek"))
    from tabloom.functions.dates import is_temporal
    for c in plan.raw_categorical_features:
        if c not in cols:
            exprs.append(F.lit(None).cast("string").alias(c))
        else:
            exprs.append(_c(c).cast("string").alias(c) if is_temporal(types[c]) else _c(c).alias(c))
    return d.select(*exprs)


class FeaturePreparer:
    """Estimator: ``fit(train)`` -> ``PreparedFeatures``; ``fit_folds`` fits one
    preparation per cross-validation fold from shared passes."""

    def __init__(self, plan: FeaturePlan, max_levels: int = MAX_LEVELS):
        self.plan = plan
        self.max_levels = max_levels

    def fit(self, train: DataFrame) -> PreparedFeatures:
        return self._fit_sets(train, None, [None])[0]

    def fit_folds(self, folded: DataFrame, k: int, fold_col: str = "fold") -> list[PreparedFeatures]:
        """Fold f is fitted on the rows of every other fold. Level counts and numeric
        moments are aggregated once per fold and combined over the complement, so all
        k fits share the same passes (the reference refits per fold; the statistics
        are identical)."""
        cfg = self.plan.overrides or ov.empty()
        if any(r["kind"] == "frequency_count" for r in cfg.get(ov.DERIVED, [])):
            # derived features depend on each fold's own map: fit fold by fold
            return [self.fit(folded.where(F.col(fold_col) != f)) for f in range(k)]
        return self._fit_sets(folded, fold_col, [set(range(k)) - {f} for f in range(k)])

    def _fit_sets(self, df: DataFrame, group_col: str | None, sets: list[set | None]) -> list[PreparedFeatures]:
        from tabloom.functions.dates import is_temporal
        from tabloom.session import cut_lineage
        plan = self.plan
        cfg = plan.overrides or ov.empty()
        types = {f.name: f.dataType for f in df.schema.fields}
        temporal = [c for c in plan.raw_categorical_features if c in types and is_temporal(types[c])]
        if temporal:
            df = df.select(*[_c(c).cast("string").alias(c) if c in temporal else _c(c) for c in df.columns])
            types = {f.name: f.dataType for f in df.schema.fields}
        g = F.col(f"`{group_col}`") if group_col else F.lit(0)

        def member(sset, col=g):
            return F.lit(True) if sset is None else col.isin(sorted(sset))

        in_set = lambda gid, s: s is None or gid in s
        cats = [c for c in plan.raw_categorical_features if c in types]
        sources = list(dict.fromkeys(r["source"] for r in cfg.get(ov.DERIVED, [])
                                     if r["kind"] == "frequency_count" and r["source"] in types))
        raw_types = {c: types[c].simpleString() for c in cats}
        fills = [dict() for _ in sets]
        categories = [dict() for _ in sets]
        level_tables, level_sizes = [dict() for _ in sets], [dict() for _ in sets]

        # categorical levels and modes: one value-table aggregate (by group), bounded collect
        if cats:
            # the value table, additionally keyed by the group (fold) of each row
            ent = [F.struct(F.lit(i).alias("pos"),
                            _c(c).cast("string").alias("value"),
                            (_c(c).cast("double") if is_numeric_type(types[c]) else F.lit(None).cast("double")).alias("value_num"))
                   for i, c in enumerate(cats)]
            vt = (df.select(g.alias("_g"), F.inline(F.array(*ent)))
                  .groupBy("_g", "pos", "value_num", "value").agg(F.count(F.lit(1)).alias("count")))
            # one bounded collect: at most groups x columns x max_levels rows are needed,
            # so one more row than that proves some column is over the level cap
            cap = len(sets) * len(cats) * self.max_levels
            rows = vt.limit(cap + 1).collect()
            levels_per_pos: dict[int, set] = {}
            for r in rows:
                levels_per_pos.setdefault(r["pos"], set()).add((r["value_num"], r["value"]))
            large: list[int] = []
            if len(rows) > cap or any(len(v) > self.max_levels for v in levels_per_pos.values()):
                vt = cut_lineage(vt)
                many = vt.select("pos", "value_num", "value").distinct().groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.max_levels)
                large = sorted(r["pos"] for r in many.collect())
                rows = vt.where(~F.col("pos").isin(large)).collect()
            for si, sset in enumerate(sets):
                for pos in large:
                    part = vt.where(F.col("pos") == pos)
                    self._level_table(part if sset is None else part.where(member(sset, F.col("_g"))), cats[pos], types[cats[pos]], fills[si], level_tables[si], level_sizes[si])
            for si, sset in enumerate(sets):
                by: dict[int, dict] = {}
                for r in rows:
                    if in_set(r["_g"], sset):
                        key = (r["value_num"], r["value"])
                        by.setdefault(r["pos"], {})
                        by[r["pos"]][key] = by[r["pos"]].get(key, 0) + r["count"]
                for pos, c in enumerate(cats):
                    if pos in large:
                        continue
                    f, order = self._levels(c, types[c], by.get(pos, {}))
                    if f is not _NO_FILL:
                        fills[si][c] = f
                    categories[si][c] = order

        # D1 frequency maps over raw training values (NULL kept), materialised once
        freq_maps: list[dict] = [dict() for _ in sets]
        freq_sizes: list[dict] = [dict() for _ in sets]
        for src in sources:
            for si, sset in enumerate(sets):
                part = df if sset is None else df.where(member(sset))
                m = part.groupBy(_c(src).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("count"))
                m = cut_lineage(m)
                freq_maps[si][src] = m
                freq_sizes[si][src] = m.count()

        # numeric statistics on the pre-frame (row-local, the same for every set here)
        nums = list(plan.numeric_features)
        scalers = [dict() for _ in sets]
        if nums:
            pre = _pre_frame(plan, df.withColumn("_g", g), freq_maps[0], freq_sizes[0], keep=["_g"])
            aggs = [F.count(F.lit(1)).alias("_n")]
            for i, c in enumerate(nums):
                x = _c(c)
                aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"),
                         F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            grows = pre.groupBy("_g").agg(*aggs).collect()
            stats = [self._combine([r for r in grows if in_set(r["_g"], sset)], len(nums)) for sset in sets]
            med = [c for c in nums if plan.imputation.get(c, {}).get("strategy") == "median"]
            rob = [c for c in nums if plan.scaling.get(c) == "robust"]
            qcols, qreq, known = [], {}, {}
            for si, sset in enumerate(sets):
                for c in sorted(set(med) | set(rob)):
                    i = nums.index(c)
                    name = f"{c}\u0001{si}"
                    qcols.append(F.when(member(sset, F.col("_g")), _c(c)).alias(name))
                    qreq[name] = sorted(set(([0.5] if c in med else []) + ([0.25, 0.5, 0.75] if c in rob else [])))
                    known[name] = (stats[si]["n1"][i], stats[si]["lo"][i], stats[si]["hi"][i])
            qs = exact_quantiles(pre.select(*qcols), qreq, known) if qreq else {}
            refill = {}
            for si, sset in enumerate(sets):
                st = stats[si]
                for i, c in enumerate(nums):
                    imp = plan.imputation.get(c)
                    f = None
                    if imp is not None:
                        s_ = imp["strategy"]
                        f = (st["m1"][i] if s_ == "mean" else qs.get((f"{c}\u0001{si}", 0.5)) if s_ == "median"
                             else float(imp["value"]) if s_ == "constant" else None)
                        if f is not None:
                            fills[si][c] = float(f)
                    n0 = (st["n"] - st["n1"][i]) if f is not None else 0
                    method = plan.scaling.get(c, "none")
                    if method == "robust" and n0 and f is not None:
                        refill[(si, c)] = f
                    sc = self._scaler(method, st["n1"][i], st["m1"][i], st["v1"][i], st["lo"][i], st["hi"][i],
                                      f, n0, qs, f"{c}\u0001{si}")
                    if sc is not None:
                        scalers[si][c] = sc
            if refill:
                # robust scaling of an imputed column: quantiles of the filled column
                cols2, req2 = [], {}
                for (si, c), f in refill.items():
                    name = f"{c}\u0002{si}"
                    cols2.append(F.when(member(sets[si], F.col("_g")), F.coalesce(_c(c), F.lit(f))).alias(name))
                    req2[name] = [0.25, 0.5, 0.75]
                q2 = exact_quantiles(pre.select(*cols2), req2)
                for (si, c) in refill:
                    name = f"{c}\u0002{si}"
                    q1, qm, q3 = q2.get((name, 0.25)), q2.get((name, 0.5)), q2.get((name, 0.75))
                    if qm is not None:
                        scalers[si][c] = (qm, (q3 - q1) if (q3 - q1) > 0 else 1.0)
        return [PreparedFeatures(plan, fills[si], scalers[si], categories[si], freq_maps[si], freq_sizes[si], raw_types, level_tables[si], level_sizes[si])
                for si in range(len(sets))]

    def _level_table(self, counts: DataFrame, c: str, dtype, fills: dict, tables: dict, sizes: dict) -> None:
        """The levels of a feature with very many of them, as a table (level, index) numbered in their order, NULL last: dealt by range,
        numbered within each range, the ranges' numbers of levels added up. Its fill, if it has one, is one row of an aggregate."""
        from tabloom.session import cut_lineage
        kind = dtype.simpleString()
        typed = (F.col("value_num") if kind in ("float", "double") else F.col("value")).cast(kind)
        levels = counts.select(typed.alias("level"), "count").groupBy("level").agg(F.sum("count").alias("count"))
        imp = self.plan.imputation.get(c)
        fill = None
        if imp is not None:
            if imp["strategy"] == "most_frequent":
                best = levels.where("level is not null").agg(F.min(F.struct((-F.col("count")).alias("n"), "level")).alias("best")).first()["best"]
                fill = best["level"] if best else None
            elif imp["strategy"] == "constant":
                fill = _typed(imp["value"], kind)
        if fill is not None:  # imputation happens before encoding: NULL becomes the fill
            fills[c] = fill
            one = counts.sparkSession.range(1).select(F.lit(fill).cast(kind).alias("level"), F.lit(0).cast("bigint").alias("count"))
            levels = levels.where("level is not null").unionByName(one).groupBy("level").agg(F.sum("count").alias("count"))
        order = F.col("level").asc_nulls_last()
        dealt = cut_lineage(levels.select("level").repartitionByRange(order).withColumn("part", F.spark_partition_id()))
        before, start = {}, 0
        for r in sorted(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
            before[r["part"]], start = start, start + r["n"]
        offset = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("part"))
        within = F.row_number().over(Window.partitionBy("part").orderBy(order))
        tables[c] = cut_lineage(dealt.select("level", (offset + within - 1).cast("int").alias("index")))
        sizes[c] = start

    def _levels(self, c: str, dtype, counts: dict):
        """Fill value (most frequent / constant) and sorted encoder levels of one column."""
        plan = self.plan
        numeric, kind = is_numeric_type(dtype), dtype.simpleString()

        def typed(key):
            num, text = key
            return None if text is None else _typed(num if kind in ("float", "double") else text, kind)

        imp = plan.imputation.get(c)
        nonnull = [(k, n) for k, n in counts.items() if n > 0 and typed(k) is not None]
        fill = _NO_FILL
        if imp is not None:
            if imp["strategy"] == "most_frequent" and nonnull:
                best = min(nonnull, key=lambda kn: (-kn[1], kn[0][0] if numeric else kn[0][1]))
                fill = typed(best[0])
            elif imp["strategy"] == "constant":
                fill = _typed(imp["value"], kind)
        vals = [typed(k) for k, n in counts.items() if n > 0]
        if fill is not _NO_FILL:  # imputation happens before encoding: NULL becomes the fill
            vals = [v for v in vals if v is not None]
            if fill not in vals:
                vals.append(fill)
        present = [v for v in vals if v is not None]
        order = sorted(set(present), key=lambda v: (str(type(v)), v))
        if any(v is None for v in vals):
            order.append(None)
        return fill, order

    @staticmethod
    def _combine(rows, p: int) -> dict:
        """Pool per-group (count, non-null count, mean, population variance, min, max)."""
        n = sum(r["_n"] for r in rows)
        out = {"n": n, "n1": [], "m1": [], "v1": [], "lo": [], "hi": []}
        for i in range(p):
            parts = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"], r[f"lo{i}"], r[f"hi{i}"]) for r in rows if r[f"n{i}"]]
            n1 = sum(q[0] for q in parts)
            if n1 == 0:
                out["n1"].append(0), out["m1"].append(None), out["v1"].append(None)
                out["lo"].append(None), out["hi"].append(None)
                continue
            mean = sum(q[0] * q[1] for q in parts) / n1
            m2 = sum(q[0] * (q[2] + (q[1] - mean) ** 2) for q in parts)
            out["n1"].append(n1), out["m1"].append(mean), out["v1"].append(m2 / n1)
            out["lo"].append(min(q[3] for q in parts)), out["hi"].append(max(q[4] for q in parts))
        return out

    @staticmethod
    def _scaler(method, n1, m1, v1, lo, hi, f, n0, qs, qname):
        if method == "standard":
            if n1 == 0 and n0 == 0:
                return None
            tot = n1 + n0
            mean = ((n1 * (m1 or 0.0)) + n0 * (f or 0.0)) / tot
            var = (n1 * ((v1 or 0.0) + ((m1 or 0.0) - mean) ** 2) + n0 * ((f or 0.0) - mean) ** 2) / tot
            sd = math.sqrt(max(var, 0.0))
            return (mean, sd if sd > 10 * 2.220446049250313e-16 * max(abs(mean), 1.0) and sd > 0 else 1.0)
        if method == "minmax":
            los = [v for v in (lo, f if n0 else None) if v is not None]
            his = [v for v in (hi, f if n0 else None) if v is not None]
            if not los:
                return None
            a, b = min(los), max(his)
            return (a, (b - a) if (b - a) > 0 else 1.0)
        if method == "robust":
            q1, q2, q3 = qs.get((qname, 0.25)), qs.get((qname, 0.5)), qs.get((qname, 0.75))
            if q2 is None:
                return None
            return (q2, (q3 - q1) if (q3 - q1) > 0 else 1.0)
        return None


_NO_FILL = object()
