"""Stand-in inputs built from the test tables, each as a Spark DataFrame and as the
same SQL expression for the oracle. They only add the manufactured conditions the
reference's tests rely on (missing values, text dates with bad entries, a constant
column, identifier-style names); the jobs do all the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.io import load_dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_dataset(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_when(key: str, mod: int, col: str) -> F.Column:
    return F.when(F.col(key) % mod == 0, F.lit(None)).otherwise(F.col(col)).alias(col)


# customer with missing values on three features and on the target, plus a constant
def customer_nulls(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        _null_when("c_custkey", 11, "c_name"),
        _null_when("c_custkey", 3, "c_nationkey"),
        _null_when("c_custkey", 7, "c_acctbal"),
        _null_when("c_custkey", 13, "c_mktsegment"),
        F.lit("same").alias("c_flag"),
    )


CUSTOMER_NULLS_SQL = """customer_n AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
         'same' AS c_flag
  FROM customer)"""


# orders with the key renamed to an identifier-style name and the date as text,
# one in eleven dates broken; a second text-date column without a date-like name
def orders_text_dates(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    broken = F.when(F.col("o_orderkey") % 11 == 0, F.lit("not-a-date")).otherwise(text)
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        "o_orderstatus",
        "o_totalprice",
        broken.alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.date_format(F.col("o_orderdate"), "M/d/yyyy")).alias("o_shipped"),
        "o_orderpriority",
    )


ORDERS_TEXT_DATES_SQL = """orders_t AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice,
         CASE WHEN o_orderkey % 11 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
         CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS o_shipped,
         o_orderpriority
  FROM orders)"""


# events with missing event types
def events_nulls(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", _null_when("event_id", 7, "event_type"), "value", "props")


EVENTS_NULLS_SQL = """events_n AS (
  SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
         value, props
  FROM events)"""


def labelled_documents(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return lab.join(doc, "doc_id", "inner")


LABELLED_DOCUMENTS_SQL = """labelled AS (
  SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, d.text
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
