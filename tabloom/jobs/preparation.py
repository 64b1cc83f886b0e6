"""Feature-preparation jobs (F1-F14, T1-T13, I, Z, E, D, C1, N1).

Each job profiles its table, builds a feature plan from the profile and the
override dict, fits the preparer on the training split (exact random holdout by
key) and prepares every row. The oracle recomputes the same split with md5 +
``row_number()`` and the fitted statistics with SQL aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions.dates import sql_lenient_timestamp
from tabloom.functions.hashing import sql_row_hash
from tabloom.functions.transforms import sql_apply_rule
from tabloom.jobs import job
from tabloom.jobs import fixtures as fx
from tabloom.operators.preparer import FeaturePreparer
from tabloom.operators.profile import Brief, profile_dataset
from tabloom.operators.split import holdout_split
from tabloom.plans.feature_plan import build_feature_plan, scope_overrides
from tabloom.session import checkpoint_dir, cut_lineage
from tabloom.sources.io import load_dataset

R = 6


def prepare(df, key_cols: Sequence[str], target: str, task: str, option: str, overrides=None, *,
            fit_on: str = "train", fit_filter=None, scope: str | None = None, subset=None):
    """profile (features + target) -> plan -> fit on train rows -> prepare all rows.

    Keys are carried as ``k0, k1, ...`` next to the prepared columns."""
    keyed = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)], *df.columns)
    feats = df
    profile, _ = profile_dataset(feats, Brief("job", target, task), key_cols=list(key_cols))
    if scope is not None:
        overrides = {**(overrides or {}), **scope_overrides(profile, scope, subset)}
    plan = build_feature_plan(profile, option, overrides)
    keys = [f"k{i}" for i in range(len(key_cols))]
    if fit_on == "all":
        train = keyed
    else:
        # the split is materialised once: the fit makes several passes over it
        train = cut_lineage(holdout_split(keyed, keys, "random_holdout")).where(F.col("split") == "train")
    if fit_filter is not None:
        train = train.where(fit_filter)
    model = FeaturePreparer(plan).fit(train)
    out = model.transform(keyed, keep=keys)
    rounded = [F.round(F.col(f"`{c}`"), R).alias(c) for c in out.columns if c not in keys]
    return out.select(*keys, *rounded), model


def split_cte(source: str, keys: Sequence[str], name: str = "sp", ties: Sequence[str] = ()) -> str:
    """The random holdout of ``source`` (column ``split``) and keys renamed k0, k1, ...

    ``ties``: the other columns of the job's input, sorted by name (the library's
    tie order after the keys)."""
    h = sql_row_hash(list(keys))
    kk = ", ".join([*keys, *sorted(ties)])
    ks = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
    return f"""{name} AS (
  SELECT {ks}, *, CASE WHEN row_number() OVER (ORDER BY {h}, {kk})
                           <= CAST(ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS BIGINT)
                      THEN 'test' ELSE 'train' END AS split
  FROM {source})"""


def r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {R})"


# ---- scope and roles (F1-F10) ---------------------------------------------------------

LI_NUMERIC = ["l_discount", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_suppkey", "l_tax"]


@job("scope_only_numeric", "SELECT l_orderkey AS k0, l_linenumber AS k1, "
     + ", ".join(f"{r(c)} AS {c}" for c in LI_NUMERIC) + " FROM lineitem")
def scope_only_numeric(spark, sf_dir):
    """keep only the numeric features (dates count as categorical and leave)."""
    li = fx.table(spark, sf_dir, "lineitem")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "regression", "minimal_cleanup",
                     scope="only_numeric")
    return out


def _one_hot_sql(col: str, cats: Sequence[str]) -> str:
    return ", ".join(f"CAST(CASE WHEN {col} = '{v}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS \"{col}={v}\"" for v in cats)


@job("scope_drop_named", "SELECT l_orderkey AS k0, l_linenumber AS k1, "
     + ", ".join(f"{r(c)} AS {c}" for c in ["l_discount", "l_linenumber", "l_orderkey", "l_quantity", "l_tax"])
     + ", " + ", ".join(f"{r(e)} AS l_shipdate__{p}" for e, p in [
         ("year(l_shipdate)", "year"), ("month(l_shipdate)", "month"), ("day(l_shipdate)", "day"),
         ("isodow(l_shipdate) - 1", "dayofweek")])
     + ", " + _one_hot_sql("l_linestatus", ["F", "O"]) + ", " + _one_hot_sql("l_returnflag", ["A", "N", "R"])
     + " FROM lineitem")
def scope_drop_named(spark, sf_dir):
    """drop named features; the date becomes parts, text becomes one-hot."""
    li = fx.table(spark, sf_dir, "lineitem")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "regression", "minimal_cleanup",
                     {"drop_features": ["l_partkey", "l_suppkey", "not_a_column"]})
    return out


@job("scope_exclude_categorical", "SELECT l_orderkey AS k0, l_linenumber AS k1, "
     + ", ".join(f"{r(c)} AS {c}" for c in LI_NUMERIC)
     + ", " + ", ".join(f"{r(e)} AS l_shipdate__{p}" for e, p in [
         ("year(l_shipdate)", "year"), ("month(l_shipdate)", "month"), ("day(l_shipdate)", "day"),
         ("isodow(l_shipdate) - 1", "dayofweek")]) + " FROM lineitem")
def scope_exclude_categorical(spark, sf_dir):
    """exclude the (non-date) categorical features; the date stays as parts."""
    li = fx.table(spark, sf_dir, "lineitem")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "regression", "minimal_cleanup",
                     scope="exclude_categorical")
    return out


@job("scope_subset", "SELECT l_orderkey AS k0, l_linenumber AS k1, "
     + f"{r('l_discount')} AS l_discount, {r('l_quantity')} AS l_quantity FROM lineitem")
def scope_subset(spark, sf_dir):
    """keep only a named subset."""
    li = fx.table(spark, sf_dir, "lineitem")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "regression", "minimal_cleanup",
                     scope="subset", subset=["l_quantity", "l_discount"])
    return out


def _ordinal_sql(col: str, train_src: str) -> str:
    """Codes = position among the sorted distinct non-null training values; unseen -1."""
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE coalesce((SELECT code FROM "
            f"(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM "
            f"(SELECT DISTINCT {col} AS v FROM {train_src} WHERE {col} IS NOT NULL)) z WHERE z.v = {col}), -1.0) END")


@job("roles_recast", "WITH " + split_cte("part", ["p_partkey"]) + """,
tr AS (SELECT * FROM sp WHERE split = 'train')
SELECT k0, CAST(TRY_CAST(p_brand AS DOUBLE) AS DOUBLE) AS p_brand, """ + r("p_partkey") + " AS p_partkey, "
     + "CAST(NULL AS DOUBLE) AS p_type__year, CAST(NULL AS DOUBLE) AS p_type__month, "
     + "CAST(NULL AS DOUBLE) AS p_type__day, CAST(NULL AS DOUBLE) AS p_type__dayofweek, "
     + _ordinal_sql("p_size", "tr") + " AS p_size FROM sp")
def roles_recast(spark, sf_dir):
    """p_size numeric -> ordinal categorical, p_brand text -> numeric (NULL on bad
    text), p_type forced date-like (parts NULL), p_name forced identifier (dropped)."""
    part = fx.table(spark, sf_dir, "part")
    out, _ = prepare(part, ["p_partkey"], "p_retailprice", "regression", "minimal_cleanup", {
        "force_ordinal_features": ["p_size"], "force_numeric_features": ["p_brand"],
        "force_date_features": ["p_type"], "force_identifier_features": ["p_name"]})
    return out


TRANSFORM_RULES = [
    {"feature": "l_quantity", "kind": "log"},
    {"feature": "l_discount", "kind": "subtract", "value": 0.5},
    {"feature": "l_discount", "kind": "log1p"},
    {"feature": "l_tax", "kind": "subtract", "value": 2},
    {"feature": "l_tax", "kind": "log1p"},
    {"feature": "l_linenumber", "kind": "multiply", "value": 2.5},
    {"feature": "l_linenumber", "kind": "divide", "value": 4},
    {"feature": "l_linenumber", "kind": "add", "value": 1},
    {"feature": "l_linenumber", "kind": "square"},
    {"feature": "l_partkey", "kind": "subtract", "value": 1000},
    {"feature": "l_partkey", "kind": "abs"},
    {"feature": "l_partkey", "kind": "sqrt"},
    {"feature": "l_suppkey", "kind": "subtract", "value": 50},
    {"feature": "l_suppkey", "kind": "sqrt"},
]


def _chain_sql(col: str) -> str:
    e = col
    for rule in TRANSFORM_RULES:
        if rule["feature"] == col:
            e = sql_apply_rule(e, rule["kind"], rule.get("value"))
    return e if e != col else f"CAST({col} AS DOUBLE)"


@job("transform_chain", "SELECT l_orderkey AS k0, l_linenumber AS k1, "
     + ", ".join(f"{r(_chain_sql(c))} AS {c}" for c in LI_NUMERIC) + " FROM lineitem")
def transform_chain(spark, sf_dir):
    """Rules chain in order per column; out-of-domain inputs become NULL."""
    li = fx.table(spark, sf_dir, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "regression", "minimal_cleanup",
                     {"feature_transform_rules": TRANSFORM_RULES})
    return out


_PARTS = [("year", "year({t})"), ("month", "month({t})"), ("day", "day({t})"), ("dayofweek", "isodow({t}) - 1")]


@job("date_parts", fx.ORDERS_TEXT_DATES_SQL.replace("orders_t AS", "WITH orders_t AS") + ",\n"
     + split_cte("orders_t", ["order_id"]) + f""",
p AS (SELECT k0, split, {', '.join(f"CAST({e.format(t=sql_lenient_timestamp('o_orderdate'))} AS DOUBLE) AS {n}" for n, e in _PARTS)} FROM sp),
m AS (SELECT {', '.join(f"quantile_cont({n}, 0.5) AS m_{n}" for n, _ in _PARTS)} FROM p WHERE split = 'train')
SELECT k0, {', '.join(f"{r(f'coalesce({n}, m_{n})')} AS o_orderdate__{n}" for n, _ in _PARTS)} FROM p, m""")
def date_parts(spark, sf_dir):
    """T11-T12 + I5: lenient parse, parts (Monday = 0), median repair of broken dates."""
    o = fx.orders_text_dates(spark, sf_dir).select("order_id", "o_orderdate", "o_orderpriority")
    out, _ = prepare(o, ["order_id"], "o_orderpriority", "classification", "minimal_cleanup",
                     {"drop_features": ["order_id"]})
    return out


# ---- imputation (I1-I5) ------------------------------------------------------------------

def _cust(spark, sf_dir):
    return fx.customer_nulls(spark, sf_dir).select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def _impute_sql(agg: str) -> str:
    return ("WITH " + fx.CUSTOMER_NULLS_SQL + ",\n" + split_cte("customer_n", ["c_custkey"]) + f""",
st AS (SELECT {agg.format(c='c_acctbal')} AS f_acct, {agg.format(c='c_nationkey')} AS f_nat FROM sp WHERE split = 'train')
SELECT k0, {r('coalesce(c_acctbal, f_acct)')} AS c_acctbal, {r('coalesce(c_nationkey, f_nat)')} AS c_nationkey
FROM sp, st""")


@job("impute_mean", _impute_sql("avg({c})"))
def impute_mean(spark, sf_dir):
    """Mean of the training rows fills missing numeric values."""
    out, _ = prepare(_cust(spark, sf_dir), ["c_custkey"], "c_mktsegment", "classification", "minimal_cleanup", {
        "drop_features": ["c_custkey"],
        "feature_imputation_rules": [{"feature": "c_acctbal", "strategy": "mean"},
                                     {"feature": "c_nationkey", "strategy": "mean"}]})
    return out


@job("impute_median", _impute_sql("quantile_cont({c}, 0.5)"))
def impute_median(spark, sf_dir):
    """I2 (and the default I5): exact median of the training rows."""
    out, _ = prepare(_cust(spark, sf_dir), ["c_custkey"], "c_mktsegment", "classification", "minimal_cleanup",
                     {"drop_features": ["c_custkey"]})
    return out


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@job("impute_mode", "WITH " + fx.CUSTOMER_NULLS_SQL + ",\n" + split_cte("customer_n", ["c_custkey"]) + """,
md AS (SELECT c_mktsegment AS f FROM sp WHERE split = 'train' AND c_mktsegment IS NOT NULL
       GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1),
im AS (SELECT k0, coalesce(c_mktsegment, (SELECT f FROM md)) AS seg FROM sp)
SELECT k0, """ + _one_hot_sql("seg", SEGMENTS).replace('"seg=', '"c_mktsegment=') + " FROM im")
def impute_mode(spark, sf_dir):
    """Most frequent training value (ties -> smallest) fills, then one-hot."""
    df = fx.customer_nulls(spark, sf_dir).select("c_custkey", "c_mktsegment", "c_nationkey")
    out, _ = prepare(df, ["c_custkey"], "c_nationkey", "regression", "minimal_cleanup",
                     {"drop_features": ["c_custkey"]})
    return out


@job("impute_constant", "WITH " + fx.CUSTOMER_NULLS_SQL + ",\n" + split_cte("customer_n", ["c_custkey"]) + """,
im AS (SELECT k0, coalesce(c_acctbal, -1.0) AS c_acctbal, coalesce(c_mktsegment, 'UNKNOWN') AS seg FROM sp)
SELECT k0, """ + r("c_acctbal") + " AS c_acctbal, "
     + _one_hot_sql("seg", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNKNOWN"]).replace('"seg=', '"c_mktsegment=')
     + " FROM im")
def impute_constant(spark, sf_dir):
    """I4: constant fills, typed by column; the fill becomes a category of its own."""
    df = fx.customer_nulls(spark, sf_dir).select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    out, _ = prepare(df, ["c_custkey"], "c_nationkey", "regression", "minimal_cleanup", {
        "drop_features": ["c_custkey"],
        "feature_imputation_rules": [{"feature": "c_acctbal", "strategy": "constant", "value": -1},
                                     {"feature": "c_mktsegment", "strategy": "constant", "value": "UNKNOWN"}]})
    return out


# ---- scaling (Z1-Z5) -------------------------------------------------------------------

SCALE_COLS = ["l_discount", "l_extendedprice", "l_quantity"]
_SCALE_TIES = ["l_orderkey", "l_linenumber", *SCALE_COLS, "l_tax"]


def _scale_job(spark, sf_dir, method):
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS, "l_tax")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_tax", "regression", "minimal_cleanup", {
        "drop_features": ["l_orderkey", "l_linenumber"],
        "feature_scaling_rules": [{"feature": c, "method": method} for c in SCALE_COLS]})
    return out


def _scale_sql(stats: str, expr: str) -> str:
    sel = ", ".join(stats.format(c=c) for c in SCALE_COLS)
    outs = ", ".join(f"{r(expr.format(c=c))} AS {c}" for c in SCALE_COLS)
    return "WITH " + split_cte("lineitem", ["l_orderkey", "l_linenumber"], ties=_SCALE_TIES) + f""",
st AS (SELECT {sel} FROM sp WHERE split = 'train')
SELECT k0, k1, {outs} FROM sp, st"""


@job("scale_standard", _scale_sql("avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}",
                                  "({c} - m_{c}) / s_{c}"))
def scale_standard(spark, sf_dir):
    """Population standard deviation of the training rows; zero -> 1."""
    return _scale_job(spark, sf_dir, "standard")


@job("scale_minmax", _scale_sql("min({c}) AS lo_{c}, CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1.0 END AS w_{c}",
                                "({c} - lo_{c}) / w_{c}"))
def scale_minmax(spark, sf_dir):
    """Training min/max; a constant column maps to 0."""
    return _scale_job(spark, sf_dir, "minmax")


@job("scale_robust", _scale_sql("quantile_cont({c}, 0.5) AS q2_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 0 "
                                "THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1.0 END AS iqr_{c}",
                                "({c} - q2_{c}) / iqr_{c}"))
def scale_robust(spark, sf_dir):
    """Z3: median and interquartile range (exact, linear) of the training rows."""
    return _scale_job(spark, sf_dir, "robust")


# ---- encoding (E1-E3) -------------------------------------------------------------------

STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@job("one_hot_wide", "SELECT o_orderkey AS k0, " + _one_hot_sql("o_orderpriority", PRIORITIES) + ", "
     + _one_hot_sql("o_orderstatus", STATUSES) + " FROM orders")
def one_hot_wide(spark, sf_dir):
    """Sorted training categories, all levels kept."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    out, _ = prepare(o, ["o_orderkey"], "o_totalprice", "regression", "minimal_cleanup",
                     {"drop_features": ["o_orderkey"]})
    return out


@job("ordinal_codes", "WITH " + split_cte("part", ["p_partkey"]) + """,
tr AS (SELECT * FROM sp WHERE split = 'train')
SELECT k0, """ + _ordinal_sql("p_brand", "tr") + " AS p_brand, " + _ordinal_sql("p_type", "tr") + " AS p_type FROM sp")
def ordinal_codes(spark, sf_dir):
    """Ascending codes from the training rows."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    out, _ = prepare(p, ["p_partkey"], "p_retailprice", "regression", "minimal_cleanup",
                     {"drop_features": ["p_partkey"], "force_ordinal_features": ["p_brand", "p_type"]})
    return out


@job("encode_unseen", "WITH " + split_cte("orders", ["o_orderkey"]) + """,
tr AS (SELECT * FROM sp WHERE split = 'train' AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P')
SELECT k0, """ + _one_hot_sql("o_orderpriority", PRIORITIES[:4]) + ", "
     + _ordinal_sql("o_orderstatus", "tr") + " AS o_orderstatus FROM sp")
def encode_unseen(spark, sf_dir):
    """E1/E2 on levels absent from the fit rows: one-hot all zeros, ordinal -1."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    out, _ = prepare(o, ["o_orderkey"], "o_totalprice", "regression", "minimal_cleanup",
                     {"drop_features": ["o_orderkey"], "force_ordinal_features": ["o_orderstatus"]},
                     fit_filter=(F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderstatus") != "P"))
    return out


# ---- derived frequency counts (D1-D2) -------------------------------------------------------

@job("frequency_count", "WITH " + fx.EVENTS_NULLS_SQL + ",\n" + split_cte("events_n", ["event_id"]) + """,
fm AS (SELECT event_type AS v, CAST(count(*) AS DOUBLE) AS n FROM sp WHERE split = 'train' GROUP BY event_type)
SELECT k0, coalesce(fm.n, 0.0) AS event_type__frequency_count
FROM sp LEFT JOIN fm ON sp.event_type IS NOT DISTINCT FROM fm.v""")
def frequency_count(spark, sf_dir):
    """Count of each raw training value (NULL included); unseen -> 0."""
    e = fx.events_nulls(spark, sf_dir).select("event_id", "event_type", "value")
    out, _ = prepare(e, ["event_id"], "value", "regression", "minimal_cleanup", {
        "drop_features": ["event_id", "event_type"],
        "keep_features": [],
        "derived_feature_rules": [{"kind": "frequency_count", "source": "event_type"}]})
    return out


# ---- whole matrix (C1, F13) and whole-table fitting (N1) -----------------------------------

_MATRIX_NUM = ["l_discount", "l_quantity", "l_tax"]


_MATRIX_TIES = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate", "l_extendedprice"]


@job("prepare_matrix", "WITH " + split_cte("lineitem", ["l_orderkey", "l_linenumber"], ties=_MATRIX_TIES) + ",\n"
     + "p AS (SELECT k0, k1, split, l_discount, l_quantity, l_tax, "
     + ", ".join(f"CAST({e.format(t='l_shipdate')} AS DOUBLE) AS l_shipdate__{n}" for n, e in _PARTS)
     + ", l_returnflag, l_linestatus FROM sp),\n"
     + "st AS (SELECT " + ", ".join(
         f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
         for c in _MATRIX_NUM + [f"l_shipdate__{n}" for n, _ in _PARTS]) + " FROM p WHERE split = 'train')\n"
     + "SELECT k0, k1, " + ", ".join(f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}"
                                     for c in _MATRIX_NUM + [f"l_shipdate__{n}" for n, _ in _PARTS])
     + ", " + _one_hot_sql("l_linestatus", ["F", "O"]) + ", " + _one_hot_sql("l_returnflag", ["A", "N", "R"])
     + " FROM p, st")
def prepare_matrix(spark, sf_dir):
    """C1 + F13: automatic preparation (standard scaling incl. date parts, one-hot)."""
    li = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate", "l_extendedprice")
    out, _ = prepare(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "regression",
                     "auto_tabular_preprocessing", {"drop_features": ["l_orderkey", "l_linenumber"]})
    return out


@job("prepare_whole_table", "WITH " + fx.CUSTOMER_NULLS_SQL + """,
f AS (SELECT avg(c_acctbal) AS fa, avg(c_nationkey) AS fn FROM customer_n),
i AS (SELECT c_custkey AS k0, coalesce(c_acctbal, fa) AS a, coalesce(c_nationkey, fn) AS n FROM customer_n, f),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(n) AS mn, stddev_pop(n) AS sn FROM i)
SELECT k0, """ + r("(a - ma) / sa") + " AS c_acctbal, " + r("(n - mn) / sn") + " AS c_nationkey FROM i, st")
def prepare_whole_table(spark, sf_dir):
    """The export form fits imputation and scaling on all rows (leakage-prone option)."""
    out, _ = prepare(_cust(spark, sf_dir), ["c_custkey"], "c_mktsegment", "classification", "custom", {
        "drop_features": ["c_custkey"],
        "feature_imputation_rules": [{"feature": "c_acctbal", "strategy": "mean"},
                                     {"feature": "c_nationkey", "strategy": "mean"}]}, fit_on="all")
    return out


# ---- levels of every type and number (E1, E2) ------------------------------------------------

def _hot_index(spark, df, feature: str, key: str, target: str, overrides: dict):
    """The position of the 1 in the assembled vector of one categorical feature, fitted on the training rows."""
    profile, _ = profile_dataset(df, Brief("levels", target, "regression"), key_cols=[key])
    plan = build_feature_plan(profile, "minimal_cleanup", {"drop_features": [key], **overrides})
    train = cut_lineage(holdout_split(df, [key], "random_holdout")).where(F.col("split") == "train")
    vector = FeaturePreparer(plan).fit(train.drop("split")).assemble(df, [key]).select(F.col(key).alias("k0"), vector_to_array("features").alias("v"))
    return vector.select("k0", F.size("v").alias("levels"), F.nullif(F.array_position("v", F.lit(1.0)), F.lit(0)).cast("int").alias("level")).withColumn("level", F.col("level") - 1)


def _hot_index_sql(source: str, key: str, feature: str, ties: Sequence[str]) -> str:
    return "WITH src AS (" + source + "), " + split_cte("src", [key], ties=ties) + f""",
m AS (SELECT {feature} AS fill FROM sp WHERE split = 'train' AND {feature} IS NOT NULL GROUP BY {feature} ORDER BY count(*) DESC, {feature} LIMIT 1),
im AS (SELECT k0, split, coalesce({feature}, (SELECT fill FROM m)) AS x FROM sp),
lv AS (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT x FROM im WHERE split = 'train'))
SELECT k0, (SELECT CAST(count(*) AS INTEGER) FROM lv) AS levels, lv.i AS level FROM im LEFT JOIN lv ON im.x = lv.x"""


_MANY = "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'k' || CAST(o_orderkey % 13000 AS VARCHAR) END AS tag, o_totalprice FROM orders"


@job("one_hot_many_levels", _hot_index_sql(_MANY, "o_orderkey", "tag", ["o_orderkey", "tag", "o_totalprice"]))
def one_hot_many_levels(spark, sf_dir):
    """E1 with more levels than are ever fetched: numbered by their distributed order, joined, one sparse vector."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, None).otherwise(
        F.concat(F.lit("k"), (F.col("o_orderkey") % 13000).cast("string"))).alias("tag"), "o_totalprice")
    return _hot_index(spark, o, "tag", "o_orderkey", "o_totalprice", {})


@job("ordinal_many_levels", "SELECT k0, coalesce(CAST(level AS DOUBLE), -1.0) AS tag FROM (" + _hot_index_sql(_MANY, "o_orderkey", "tag", ["o_orderkey", "tag", "o_totalprice"]) + ")")
def ordinal_many_levels(spark, sf_dir):
    """E2 with more levels than are ever fetched: codes from a join, unseen levels -1, missing ones the most frequent level."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, None).otherwise(
        F.concat(F.lit("k"), (F.col("o_orderkey") % 13000).cast("string"))).alias("tag"), "o_totalprice")
    out, _ = prepare(o, ["o_orderkey"], "o_totalprice", "regression", "minimal_cleanup", {"drop_features": ["o_orderkey"], "force_ordinal_features": ["tag"]})
    return out


@job("one_hot_decimal", _hot_index_sql("SELECT o_orderkey, CAST(o_orderkey % 61 AS DECIMAL(12, 2)) / 4 AS d, o_totalprice FROM orders", "o_orderkey", "d", ["d", "o_orderkey", "o_totalprice"]))
def one_hot_decimal(spark, sf_dir):
    """E1 on a decimal column kept as categories: levels in the order of their values."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 61).cast("decimal(12,2)") / 4).alias("d"), "o_totalprice")
    return _hot_index(spark, o, "d", "o_orderkey", "o_totalprice", {"force_categorical_features": ["d"]})


@job("one_hot_boolean", _hot_index_sql("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice > 150000 END AS b, o_totalprice FROM orders", "o_orderkey", "b",
                                       ["b", "o_orderkey", "o_totalprice"]))
def one_hot_boolean(spark, sf_dir):
    """E1 on booleans kept as categories: false, true; missing ones are the more frequent."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_totalprice") > 150000).alias("b"), "o_totalprice")
    return _hot_index(spark, o, "b", "o_orderkey", "o_totalprice", {"force_categorical_features": ["b"]})


# ---- CSV (S1, S3) --------------------------------------------------------------------------

@job("csv_scan", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 2 = 0 END AS flag,
       CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 100 END AS small, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
       CAST(o_custkey AS VARCHAR) || 'd' AS code, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS status, CAST(o_custkey AS DOUBLE) / 4 AS share,
       '9999999999999999999' || CAST(o_orderkey % 10 AS VARCHAR) AS digits FROM orders""")
def csv_scan(spark, sf_dir):
    """A folder of CSV files, types by the evidence of all cells: booleans, whole numbers, doubles in several spellings, text
    that only looks like numbers, numbers beyond 64 bits, missing tokens."""
    import uuid
    o = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    tokens = F.element_at(F.array(*[F.lit(t) for t in ("NA", "null", "n/a", "")]), (key % 4 + 1).cast("int"))
    price = F.col("o_totalprice")
    text = o.select(key.cast("string").alias("id"),
                    F.when(key % 13 == 0, tokens).when(key % 2 == 0, F.when(key % 4 == 0, "TRUE").otherwise("True")).otherwise("false").alias("flag"),
                    F.when(key % 17 == 0, tokens).otherwise((F.col("o_custkey") % 100).cast("string")).alias("small"),
                    F.when(key % 11 == 0, tokens).otherwise(price.cast("string")).alias("price"),
                    F.concat(F.col("o_custkey").cast("string"), F.lit("d")).alias("code"),
                    F.when(key % 19 == 0, tokens).otherwise(F.col("o_orderstatus")).alias("status"),
                    F.when(F.col("o_custkey") % 3 == 0, F.concat((F.col("o_custkey") * 25).cast("string"), F.lit("e-2"))).otherwise((F.col("o_custkey") / 4).cast("string")).alias("share"),
                    F.concat(F.lit("9999999999999999999"), (key % 10).cast("string")).alias("digits"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    text.write.option("header", True).csv(path)
    return load_dataset(spark, path)
