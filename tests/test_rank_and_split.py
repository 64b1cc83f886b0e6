"""K1 exact rank against a one-partition row_number, with many buckets, heavy ties,
NULL sort keys and different input partitionings; split sizes and disjointness."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import row_hash
from tabloom.operators.quantile import exact_quantiles
from tabloom.operators.rank import exact_rank
from tabloom.operators.split import assign_folds, holdout_split, leakage_check


def _skewed(spark, n=5000):
    # a third of the rows share one time value; some times are missing
    rows = []
    for i in range(n):
        t = 1_000_000 if i % 3 == 0 else (None if i % 17 == 0 else 1_000_000 + (i * 7919) % 100_000)
        rows.append((i, t, ["a", "b", "c"][i % 3] if i % 11 else "a"))
    return spark.createDataFrame(rows, "k long, t long, cls string")


def test_hash_rank_matches_single_partition(spark):
    df = _skewed(spark).withColumn("_h", row_hash(["k"]))
    got = exact_rank(df, F.col("_h"), ["k"], partition_cols=["cls"], rows_per_bucket=64, rank_col="r")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("cls").orderBy("_h", "k")))
    joined = got.join(want, "k").where(F.col("r") != F.col("w"))
    assert joined.count() == 0


def test_range_rank_with_heavy_value_and_nulls(spark):
    df = _skewed(spark).withColumn("_h", row_hash(["k"]))
    key = F.coalesce(F.col("t"), F.lit((1 << 63) - 1))
    got = exact_rank(df, key, ["_h", "k"], order="range", tie_hash=F.col("_h"), rows_per_bucket=64, rank_col="r")
    want = df.withColumn("w", F.row_number().over(Window.orderBy(F.col("t").asc_nulls_last(), "_h", "k")))
    assert got.join(want, "k").where(F.col("r") != F.col("w")).count() == 0


def test_split_sizes_partition_independent(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    n = o.count()
    a = holdout_split(o.repartition(1), ["o_orderkey"]).where("split = 'test'").select("o_orderkey")
    b = holdout_split(o.repartition(7), ["o_orderkey"]).where("split = 'test'").select("o_orderkey")
    assert a.count() == math.ceil(0.2 * n)
    assert a.exceptAll(b).count() == 0
    chk = leakage_check(holdout_split(o, ["o_orderkey"]), ["o_orderkey"]).first()
    assert chk["overlap_rows"] == 0 and chk["train_rows"] + chk["test_rows"] == n


def test_stratified_split_keeps_shares(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    s = holdout_split(lab, ["doc_id"], "stratified_holdout", target="quality", task_type="classification")
    n = lab.count()
    test = s.where("split = 'test'")
    assert test.count() == math.ceil(0.2 * n)
    share_all = lab.where("quality = 0").count() / n
    share_test = test.where("quality = 0").count() / test.count()
    assert abs(share_all - share_test) < 0.02


def test_folds_balanced(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    f = assign_folds(lab, ["doc_id"], 5, target="quality", stratified=True)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_exact_quantiles_small_buckets(spark):
    import numpy as np
    import tabloom.operators.quantile as Q
    old = Q.ACCURACY, Q.RANGE_ROWS
    Q.ACCURACY, Q.RANGE_ROWS = 100, 50
    try:
        vals = [float((i * 37) % 1001) for i in range(3000)] + [5.0] * 2000
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        got = exact_quantiles(df, {"x": [0.1, 0.25, 0.5, 0.9]})
        for p in (0.1, 0.25, 0.5, 0.9):
            assert got[("x", p)] == np.percentile(vals, p * 100)
    finally:
        Q.ACCURACY, Q.RANGE_ROWS = old


def test_range_rank_with_a_heavy_sentinel_beyond_2_53(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tabloom.functions.hashing import row_hash
    from tabloom.operators.rank import exact_rank
    top = 10_413_792_000_000_000  # 2300-01-01 in microseconds
    df = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, F.lit(top)).when(F.col("id") % 3 == 0, F.lit(top) + 1).otherwise(F.lit(top) + F.col("id")).alias("t"))
    df = df.withColumn("h", row_hash(["id"]))
    got = exact_rank(df, F.col("t"), ["h", "id"], order="range", tie_hash=F.col("h"), rows_per_bucket=100)
    want = df.withColumn("want", F.row_number().over(Window.orderBy("t", "h", "id"))).select("id", "want")
    assert got.join(want, "id").where("_rank <> want").count() == 0


def test_quantiles_with_infinite_values(spark):
    from pyspark.sql import functions as F
    from tabloom.operators import quantile as Q
    df = spark.range(5000).select(F.when(F.col("id") < 300, F.lit(float("-inf"))).when(F.col("id") >= 4900, F.lit(float("inf"))).otherwise(F.col("id").cast("double")).alias("x"),
                                  (F.exp(F.col("id") / 8.0) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("y"))
    old = Q.ACCURACY, Q.RANGE_ROWS
    Q.ACCURACY, Q.RANGE_ROWS = 200, 10
    try:
        got = Q.exact_quantiles(df, {"x": [0.0, 0.5, 1.0], "y": [0.5]})
    finally:
        Q.ACCURACY, Q.RANGE_ROWS = old
    assert got["x", 0.0] == float("-inf") and got["x", 1.0] == float("inf") and got["x", 0.5] == 2499.5
    ys = sorted(r["y"] for r in df.select("y").collect())
    assert abs(got["y", 0.5] - (ys[2499] + ys[2500]) / 2) < 1e-6


def test_quantiles_take_two_scans_and_few_values(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    from tabloom.operators import quantile as Q
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.sin("id") * 1000).alias("x"), (F.col("id") * 7919 % 100_003).cast("double").alias("y"),
                                     F.when(F.col("id") < 5, F.col("id").cast("double")).alias("z"), F.lit(None).cast("double").alias("none"), F.lit(2.5).alias("one")).repartition(5)
    written, scans = [], []
    monkeypatch.setattr(Q, "cut_lineage", lambda t, keep=Q.cut_lineage: written.append(keep(t)) or written[-1])
    monkeypatch.setattr(Q, "_order_statistics", lambda d, w, run=Q._order_statistics: scans.append(len(w)) or run(d, w))
    probs = {"x": [0.1, 0.25, 0.5], "y": [0.5, 0.999], "z": [0.5, 0.9], "none": [0.5], "one": [0.25]}
    got = Q.exact_quantiles(df, probs)
    pdf = df.toPandas()
    for c, ps in probs.items():
        v = pdf[c].dropna()
        for p in ps:
            assert (got[c, p] is None and not len(v)) or abs(got[c, p] - np.percentile(v, p * 100)) <= 1e-12 * max(1, abs(got[c, p]))
    assert len(scans) == 1 and written[0].count() < 0.01 * 2 * 200_000  # one sketch, one pass, and what lies in the brackets
