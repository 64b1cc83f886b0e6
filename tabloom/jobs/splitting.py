"""Split and fold jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.dates import sql_lenient_timestamp
from tabloom.functions.hashing import sql_row_hash
from tabloom.jobs import job
from tabloom.jobs import fixtures as fx
from tabloom.jobs.sqlgen import fold_of
from tabloom.operators.split import assign_folds, holdout_split, leakage_check, split_summary

H_ORDERS = sql_row_hash(["o_orderkey"])
H_LABELS = sql_row_hash(["doc_id"])
H_EVENTS = sql_row_hash(["event_id"])


def stratified_sql(source: str, key: str, target: str, h: str, test_size: float = 0.2) -> str:
    """Largest-remainder quotas, then the smallest hashes of each class go to test."""
    return f"""WITH b AS (SELECT {key}, {target}, {h} AS h FROM {source}),
cls AS (SELECT {target}, count(*) AS n FROM b GROUP BY {target}),
tot AS (SELECT sum(n) AS n, CAST(ceil(CAST({test_size} AS DOUBLE) * sum(n)) AS BIGINT) AS m FROM cls),
q AS (SELECT {target}, (tot.m * cls.n) // tot.n AS fl, (tot.m * cls.n) % tot.n AS rem FROM cls, tot),
q2 AS (SELECT {target}, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, {target} NULLS FIRST)
                                   <= (SELECT m FROM tot) - (SELECT sum(fl) FROM q) THEN 1 ELSE 0 END AS quota FROM q)
SELECT {key}, CASE WHEN row_number() OVER (PARTITION BY b.{target} ORDER BY h, {key}) <= quota
                  THEN 'test' ELSE 'train' END AS split
FROM b JOIN q2 ON b.{target} IS NOT DISTINCT FROM q2.{target}"""


@job("split_random", f"""WITH b AS (SELECT o_orderkey, {H_ORDERS} AS h FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h, o_orderkey)
                             <= (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) FROM b)
                        THEN 'test' ELSE 'train' END AS split
FROM b""")
def split_random(spark, sf_dir):
    """Exact-size random holdout by row hash."""
    o = fx.table(spark, sf_dir, "orders")
    return holdout_split(o, ["o_orderkey"], "random_holdout").select("o_orderkey", "split")


@job("split_stratified", stratified_sql("labels", "doc_id", "quality", H_LABELS))
def split_stratified(spark, sf_dir):
    """Class shares kept, total exactly ceil(0.2 n)."""
    lab = fx.table(spark, sf_dir, "labels")
    return holdout_split(lab, ["doc_id"], "stratified_holdout", target="quality",
                         task_type="classification").select("doc_id", "split")


@job("split_time_ordered", f"""WITH b AS (SELECT event_id, ts, {H_EVENTS} AS h FROM events)
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts NULLS LAST, h, event_id)
                           <= (SELECT CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM b)
                      THEN 'train' ELSE 'test' END AS split
FROM b""")
def split_time_ordered(spark, sf_dir):
    """Earliest 80% train; range buckets from quantiles, no single-partition sort."""
    e = fx.table(spark, sf_dir, "events")
    return holdout_split(e, ["event_id"], "time_ordered_holdout", date_column="ts").select("event_id", "split")


@job("split_time_ordered_text", f"""{fx.ORDERS_TEXT_DATES_SQL.replace('orders_t AS', 'WITH orders_t AS')},
b AS (SELECT order_id, {sql_lenient_timestamp('o_orderdate')} AS t,
             {sql_row_hash(['order_id'])} AS h FROM orders_t)
SELECT order_id, CASE WHEN row_number() OVER (ORDER BY t NULLS LAST, h, order_id)
                           <= (SELECT CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM b)
                      THEN 'train' ELSE 'test' END AS split
FROM b""")
def split_time_ordered_text(spark, sf_dir):
    """X3 on text dates: many rows share a day and broken dates go last (heavy ties)."""
    o = fx.orders_text_dates(spark, sf_dir)
    return holdout_split(o, ["order_id"], "time_ordered_holdout", date_column="o_orderdate").select("order_id", "split")


@job("kfold_stratified", f"""WITH b AS (SELECT doc_id, quality, {sql_row_hash(['doc_id'], 'fold:42')} AS h FROM labels),
cls AS (SELECT quality, count(*) AS n FROM b GROUP BY quality),
off AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY quality NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS coff FROM cls),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1 AS r FROM b)
SELECT doc_id, {fold_of('r', 'n', 5, 'coff')} AS fold
FROM r JOIN off ON r.quality IS NOT DISTINCT FROM off.quality""")
def kfold_stratified(spark, sf_dir):
    """Stratified 5-fold assignment."""
    lab = fx.table(spark, sf_dir, "labels")
    return assign_folds(lab, ["doc_id"], 5, target="quality", stratified=True).select("doc_id", "fold")


@job("kfold_random", f"""WITH b AS (SELECT l_orderkey, l_linenumber, {sql_row_hash(['l_orderkey', 'l_linenumber'], 'fold:42')} AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, {fold_of('(row_number() OVER (ORDER BY h, l_orderkey, l_linenumber) - 1)', '(SELECT count(*) FROM b)', 5)} AS fold
FROM b""")
def kfold_random(spark, sf_dir):
    """5-fold assignment over a composite key."""
    li = fx.table(spark, sf_dir, "lineitem")
    return assign_folds(li, ["l_orderkey", "l_linenumber"], 5).select("l_orderkey", "l_linenumber", "fold")


@job("split_summary", f"""WITH b AS (SELECT o_orderkey, {H_ORDERS} AS h FROM orders),
s AS (SELECT CASE WHEN row_number() OVER (ORDER BY h, o_orderkey)
                     <= (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) FROM b) THEN 'test' ELSE 'train' END AS split FROM b)
SELECT split, CAST(count(*) AS BIGINT) AS rows FROM s GROUP BY split""")
def split_summary_job(spark, sf_dir):
    """Rows per split."""
    return split_summary(holdout_split(fx.table(spark, sf_dir, "orders"), ["o_orderkey"]))


@job("split_leakage_check", """SELECT CAST(count(*) - CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS BIGINT) AS train_rows,
       CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS test_rows, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(0 AS BIGINT) AS overlap_rows FROM orders""")
def split_leakage_check(spark, sf_dir):
    """Train and test are disjoint on the key and add up to the table."""
    s = holdout_split(fx.table(spark, sf_dir, "orders"), ["o_orderkey"])
    return leakage_check(s, ["o_orderkey"])


_ORDERS_TIES = "o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice"
_DUPLICATE_KEYS = f"""WITH b AS (SELECT *, {sql_row_hash(['o_custkey'])} AS h FROM orders),
s AS (SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (ORDER BY h, {_ORDERS_TIES})
                             <= (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) FROM b)
                        THEN 'test' ELSE 'train' END AS split FROM b)"""


@job("split_random_duplicate_key", _DUPLICATE_KEYS + "\nSELECT o_orderkey, split FROM s")
def split_random_duplicate_key(spark, sf_dir):
    """X1 with a key that many rows share: the cut falls among rows of one key and is told by the other columns."""
    return holdout_split(fx.table(spark, sf_dir, "orders"), ["o_custkey"]).select("o_orderkey", "split")


@job("split_leakage_duplicate_key", _DUPLICATE_KEYS + """
SELECT CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train_rows, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS test_rows,
       CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (split = 'train' AND o_custkey IN (SELECT o_custkey FROM s WHERE split = 'test')) AS BIGINT) AS overlap_rows FROM s""")
def split_leakage_duplicate_key(spark, sf_dir):
    """X8 where the key is not unique: the rows of the key at the cut leak."""
    return leakage_check(holdout_split(fx.table(spark, sf_dir, "orders"), ["o_custkey"]), ["o_custkey"])


_HALF_MISSING = "CASE WHEN event_id % 2 = 0 THEN NULL ELSE ts END"


@job("split_time_ordered_sentinel", f"""WITH b AS (SELECT event_id, {_HALF_MISSING} AS t, {H_EVENTS} AS h FROM events)
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY t NULLS LAST, h, event_id)
                           <= (SELECT CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM b)
                      THEN 'train' ELSE 'test' END AS split
FROM b""")
def split_time_ordered_sentinel(spark, sf_dir):
    """X3 with every second time missing: the cut falls among rows without a time."""
    e = fx.table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 2 == 0, None).otherwise(F.col("ts")))
    return holdout_split(e, ["event_id"], "time_ordered_holdout", date_column="ts").select("event_id", "split")


@job("fold_sizes", f"""WITH b AS (SELECT quality, {sql_row_hash(['doc_id'], 'fold:42')} AS h, doc_id FROM labels),
cls AS (SELECT quality, count(*) AS n FROM b GROUP BY quality),
off AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY quality NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS coff FROM cls),
r AS (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1 AS r FROM b)
SELECT quality, {fold_of('r', 'n', 7, 'coff')} AS fold, CAST(count(*) AS BIGINT) AS rows FROM r JOIN off USING (quality) GROUP BY ALL""")
def fold_sizes(spark, sf_dir):
    """Rows of each class in each of 7 folds."""
    lab = fx.table(spark, sf_dir, "labels")
    return assign_folds(lab, ["doc_id"], 7, target="quality", stratified=True).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("rows"))
