"""Profiling jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.dates import sql_lenient_timestamp
from tabloom.functions.hashing import sql_row_hash
from tabloom.jobs import job
from tabloom.jobs import fixtures as fx
from tabloom.jobs.sqlgen import per_column_stats, with_
from tabloom.operators.profile import Brief, profile_dataset, role_groups

R = 6  # decimals kept on doubles in every compared result

CUSTOMER_COLS = [("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_flag", "categorical")]


def _customer_profile(spark, sf_dir):
    df = fx.customer_nulls(spark, sf_dir)
    return profile_dataset(df, Brief("customers", "c_mktsegment", "classification"), key_cols=["c_custkey"])


@job("profile_feature_table", with_(fx.CUSTOMER_NULLS_SQL, f"s AS ({per_column_stats('customer_n', CUSTOMER_COLS)})") + f"""
SELECT feature, pos, role, n_distinct, n_missing,
       round(CASE WHEN n_rows > 0 THEN n_missing / n_rows ELSE 0.0 END, {R}) AS missing_fraction,
       round(min_value, {R}) AS min_value, round(max_value, {R}) AS max_value, n_distinct <= 1 AS is_constant
FROM s""")
def profile_feature_table(spark, sf_dir):
    """P3-P8 + P22: one row per feature from the shared value table."""
    _, facts = _customer_profile(spark, sf_dir)
    return facts.select("feature", "pos", "role", "n_distinct", "n_missing",
                        F.round("missing_fraction", R).alias("missing_fraction"),
                        F.round("min_value", R).alias("min_value"), F.round("max_value", R).alias("max_value"),
                        "is_constant")


@job("profile_table_summary", with_(fx.CUSTOMER_NULLS_SQL, f"s AS ({per_column_stats('customer_n', CUSTOMER_COLS)})",
                                    "t AS (SELECT c_mktsegment, count(*) AS n FROM customer_n GROUP BY c_mktsegment)") + f"""
SELECT CAST((SELECT count(*) FROM customer_n) AS BIGINT) AS n_rows,
       CAST(6 AS BIGINT) AS n_columns,
       round((SELECT sum(n_missing) FROM s) / ((SELECT count(*) FROM customer_n) * 5.0), {R}) AS missing_fraction,
       CAST((SELECT count(*) FROM t) AS BIGINT) AS target_cardinality,
       round((SELECT CAST(max(n) AS DOUBLE) / min(n) FROM t), {R}) AS class_imbalance""")
def profile_table_summary(spark, sf_dir):
    """Table-level scalars (target NULL counts as a class)."""
    p, _ = _customer_profile(spark, sf_dir)
    return spark.createDataFrame(
        [(p.rows, p.columns, round(p.missing_fraction, R), p.target_cardinality,
          None if p.class_imbalance is None else round(p.class_imbalance, R))],
        "n_rows bigint, n_columns bigint, missing_fraction double, target_cardinality bigint, class_imbalance double")


@job("profile_high_cardinality", with_("""t AS (SELECT 'text' AS feature,
     count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS card FROM documents
   UNION ALL SELECT 'source', count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) FROM documents)""",
   "n AS (SELECT count(*) AS rows FROM documents)") + """
SELECT feature, CAST(card AS BIGINT) AS cardinality
FROM t, n
WHERE card >= greatest(20, least(100, CAST(floor(rows * 0.1) AS BIGINT))) AND card / rows >= 0.1""")
def profile_high_cardinality(spark, sf_dir):
    """P12 on documents (classification on lang): whole texts go through the value table."""
    docs = fx.table(spark, sf_dir, "documents")
    p, facts = profile_dataset(docs, Brief("documents", "lang", "classification"), key_cols=["doc_id"])
    return facts.where("is_high_cardinality").select("feature", F.col("n_distinct").alias("cardinality"))


@job("profile_identifier", with_(fx.ORDERS_TEXT_DATES_SQL, "n AS (SELECT count(*) AS rows FROM orders_t)",
                                 """d AS (SELECT 'order_id' AS feature, count(DISTINCT order_id) AS nd FROM orders_t
   UNION ALL SELECT 'customer_id', count(DISTINCT customer_id) FROM orders_t)""") + f"""
SELECT feature, CAST(nd AS BIGINT) AS n_distinct, round(nd / greatest(rows, 1), {R}) AS unique_ratio,
       nd / greatest(rows, 1) >= 0.5 AS is_identifier
FROM d, n""")
def profile_identifier(spark, sf_dir):
    """Name pattern and uniqueness; reported for the features whose name matches."""
    import re
    from tabloom.operators.profile import IDENTIFIER_PATTERN
    p, facts = profile_dataset(fx.orders_text_dates(spark, sf_dir), Brief("orders", "o_orderpriority", "classification"),
                               key_cols=["order_id"])
    names = [c for c in p.distinct_by_feature if re.search(IDENTIFIER_PATTERN, c.lower())]
    return (facts.where(F.col("feature").isin(names))
            .select("feature", "n_distinct",
                    F.round(F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1)), R).alias("unique_ratio"),
                    "is_identifier"))


def _probe_sql(source: str, key: str, cols: list[str]) -> str:
    h = sql_row_hash([key])
    union = "\n    UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, {h} AS h FROM {source} WHERE {c} IS NOT NULL" for c in cols)
    return f"""probe AS (
  SELECT feature, avg(CASE WHEN {sql_lenient_timestamp('v')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ok
  FROM (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY h, v) AS rn FROM (
    {union}))
  WHERE rn <= 250 GROUP BY feature)"""


@job("profile_date_like", with_(fx.ORDERS_TEXT_DATES_SQL, _probe_sql("orders_t", "order_id", ["o_orderstatus", "o_shipped"]),
                                f"""fails AS (
  SELECT avg(CASE WHEN {sql_lenient_timestamp('o_orderdate')} IS NULL THEN 1.0 ELSE 0.0 END) AS f_orderdate,
         avg(CASE WHEN {sql_lenient_timestamp('o_shipped')} IS NULL THEN 1.0 ELSE 0.0 END) AS f_shipped
  FROM orders_t)""") + f"""
SELECT 'o_orderstatus' AS feature, (SELECT ok FROM probe WHERE feature = 'o_orderstatus') >= 0.9 AS is_date_like,
       CAST(0.0 AS DOUBLE) AS parse_failure
UNION ALL
SELECT 'o_orderdate', true, round(CAST(f_orderdate AS DOUBLE), {R}) FROM fails
UNION ALL
SELECT 'o_shipped', (SELECT ok FROM probe WHERE feature = 'o_shipped') >= 0.9,
       round(CAST(CASE WHEN (SELECT ok FROM probe WHERE feature = 'o_shipped') >= 0.9 THEN f_shipped ELSE 0.0 END AS DOUBLE), {R})
FROM fails""")
def profile_date_like(spark, sf_dir):
    """Name rule, 250-value hash-ordered parse probe, parse failures over all rows."""
    _, facts = profile_dataset(fx.orders_text_dates(spark, sf_dir), Brief("orders", "o_orderpriority", "classification"),
                               key_cols=["order_id"])
    return (facts.where(F.col("role") == "categorical")
            .select("feature", "is_date_like", F.round("parse_failure", R).alias("parse_failure")))


@job("target_skew", f"SELECT round(skewness(value), {R}) AS target_skew, CAST(count(value) AS BIGINT) AS n FROM events")
def target_skew(spark, sf_dir):
    """Adjusted Fisher-Pearson skew of a regression target."""
    p, _ = profile_dataset(fx.table(spark, sf_dir, "events").select("event_type", "user_id", "value"),
                           Brief("events", "value", "regression"), key_cols=None)
    return spark.createDataFrame([(round(p.target_skew, R), p.rows)], "target_skew double, n bigint")


@job("class_imbalance", """
SELECT round(CAST(max(n) AS DOUBLE) / min(n), 6) AS class_imbalance, CAST(count(*) AS BIGINT) AS n_classes
FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)""")
def class_imbalance(spark, sf_dir):
    """Largest over smallest class count."""
    p, _ = profile_dataset(fx.table(spark, sf_dir, "labels"), Brief("labels", "quality", "classification"),
                           key_cols=["doc_id"])
    return spark.createDataFrame([(round(p.class_imbalance, R), len(p.class_counts))],
                                 "class_imbalance double, n_classes bigint")


@job("target_distribution", """
SELECT CAST(quality AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n,
       round(CASE WHEN quality IS NULL THEN NULL ELSE count(*) / sum(CASE WHEN quality IS NULL THEN 0 ELSE count(*) END) OVER () END, 6) AS prior
FROM labels GROUP BY quality""")
def target_distribution(spark, sf_dir):
    """Class counts (NULL kept) and priors over non-NULL labels."""
    from tabloom.operators.baseline import class_priors
    return class_priors(fx.table(spark, sf_dir, "labels"), "quality").select(
        F.col("label").cast("bigint").alias("label"), "n", F.round("prior", R).alias("prior"))


@job("missing_top3", with_(fx.CUSTOMER_NULLS_SQL, f"s AS ({per_column_stats('customer_n', CUSTOMER_COLS)})") + f"""
SELECT feature, round(n_missing / n_rows, {R}) AS missing_fraction,
       CAST(row_number() OVER (ORDER BY n_missing / n_rows DESC, pos) AS BIGINT) AS rank
FROM s WHERE n_missing > 0
QUALIFY rank <= 3""")
def missing_top3(spark, sf_dir):
    """Three features with the largest missing fraction, ties in schema order."""
    from pyspark.sql import Window
    _, facts = _customer_profile(spark, sf_dir)
    w = Window.orderBy(F.desc("missing_fraction"), "pos")  # one row per feature: bounded
    return (facts.where(F.col("n_missing") > 0)
            .select("feature", F.round("missing_fraction", R).alias("missing_fraction"),
                    F.row_number().over(w).cast("bigint").alias("rank"))
            .where(F.col("rank") <= 3))


@job("role_groups", with_(fx.ORDERS_TEXT_DATES_SQL, _probe_sql("orders_t", "order_id", ["o_orderstatus", "o_shipped"]),
                          """roles AS (SELECT * FROM (VALUES ('order_id', 'numeric'), ('customer_id', 'numeric'),
     ('o_totalprice', 'numeric'), ('o_orderstatus', 'categorical'), ('o_orderdate', 'categorical'),
     ('o_shipped', 'categorical')) AS t(feature, role))""",
                          "dl AS (SELECT 'o_orderdate' AS feature UNION ALL SELECT feature FROM probe WHERE ok >= 0.9)") + """
SELECT feature, role AS grp FROM roles
UNION ALL SELECT feature, 'date_like' FROM dl
UNION ALL SELECT feature, 'categorical_non_date' FROM roles
  WHERE role = 'categorical' AND feature NOT IN (SELECT feature FROM dl)""")
def role_groups_job(spark, sf_dir):
    """P20: role groups derived from the profile of the orders table."""
    p, _ = profile_dataset(fx.orders_text_dates(spark, sf_dir), Brief("orders", "o_orderpriority", "classification"),
                           key_cols=["order_id"])
    groups = role_groups(p)
    rows = [(c, g) for g, cols in groups.items() for c in cols]
    return spark.createDataFrame(rows, "feature string, grp string")


@job("feature_facts", with_(fx.CUSTOMER_NULLS_SQL,
                            "cn AS (SELECT c_custkey AS customer_id, c_name, c_nationkey, c_acctbal, c_mktsegment, c_flag FROM customer_n)",
                            f"s AS ({per_column_stats('cn', [('customer_id', 'numeric')] + CUSTOMER_COLS[1:])})") + f"""
SELECT feature,
       CASE WHEN n_distinct <= 1 THEN 'constant'
            WHEN feature = 'customer_id' AND n_distinct / greatest(n_rows, 1) >= 0.5 THEN 'identifier'
            WHEN role = 'categorical' AND n_distinct >= greatest(20, least(100, CAST(floor(n_rows * 0.1) AS BIGINT)))
                 AND n_distinct / n_rows >= 0.1 THEN 'high_cardinality'
            ELSE 'distinct' END AS fact_kind,
       n_distinct, round(n_distinct / greatest(n_rows, 1), {R}) AS unique_ratio,
       CASE WHEN n_missing > 0 THEN round(n_missing / n_rows, {R}) END AS missing_fraction
FROM s""")
def feature_facts(spark, sf_dir):
    """The per-feature fact with precedence constant > identifier > high-cardinality > distinct."""
    df = fx.customer_nulls(spark, sf_dir).withColumnRenamed("c_custkey", "customer_id")
    _, facts = profile_dataset(df, Brief("customers", "c_mktsegment", "classification"), key_cols=["customer_id"])
    kind = (F.when(F.col("is_constant"), "constant").when(F.col("is_identifier"), "identifier")
            .when(F.col("is_high_cardinality"), "high_cardinality").otherwise("distinct"))
    return facts.select("feature", kind.alias("fact_kind"), "n_distinct",
                        F.round(F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1)), R).alias("unique_ratio"),
                        F.when(F.col("n_missing") > 0, F.round("missing_fraction", R)).alias("missing_fraction"))
