"""Exact cuts against row_number over the whole table: hot keys, equal rows, missing values, few rows per ordered range;
and plans of splits and folds, which must not move rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import row_hash
from tabloom.operators import cuts
from tabloom.operators.split import assign_folds, fold_ends, holdout_split, tie_columns


def table(spark, n=6000):
    """A third of the rows share a key (and some all columns), another third a key with other columns that differ; times are missing or shared."""
    rows = []
    for i in range(n):
        key = 7 if i % 3 == 0 else 11 if i % 3 == 1 else i
        t = None if i % 5 == 0 else 1_000_000 if i % 4 == 0 else (i * 7919) % 100_000 - 50_000
        same = i % 3 == 0 and i % 2 == 0
        rows.append((key, 1.5 if same else float((i * 31) % 97) if i % 13 else None, "s" if same else f"v{(i * 17) % 501}", None if same else t, ["a", "b", None][i % 7 % 3]))
    return spark.createDataFrame(rows, "k long, x double, s string, t long, cls string").repartition(5)


@pytest.fixture(params=[(200, 64), (1 << 16, 1 << 17)])
def small(request, monkeypatch):
    monkeypatch.setattr(cuts, "ORDER_ROWS", request.param[0])
    monkeypatch.setattr(cuts, "BINS", request.param[1])


def counted(df, *cols):
    return sorted(((tuple(r)) for r in df.groupBy(*cols).count().collect()), key=repr)


def numbered(df, order, split):
    """The same split by one window over everything."""
    return df.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("split", split(F.col("_n"))).drop("_n")


def test_random_holdout_with_hot_keys_and_equal_rows(spark, small):
    df = table(spark)
    n = df.count()
    for size in (0.01, 0.5):
        got = holdout_split(df, ["k"], test_size=size)
        m = math.ceil(size * n)
        want = numbered(df, [row_hash(["k"], 42), *tie_columns(df, ["k"])], lambda r: F.when(r <= m, "test").otherwise("train"))
        cols = [*df.columns, "split"]
        assert got.columns == cols and counted(got, *cols) == counted(want, *cols), size


def test_time_ordered_holdout(spark, small):
    df = table(spark).withColumn("t", F.expr("timestamp_micros(t)"))
    n = df.count()
    for size in (0.3, 0.6):
        got = holdout_split(df, ["k"], "time_ordered_holdout", date_column="t", test_size=size)
        m = int(n * (1 - size))
        want = numbered(df, [F.col("t").asc_nulls_last(), row_hash(["k"], 42), *tie_columns(df, ["k"])], lambda r: F.when(r <= m, "train").otherwise("test"))
        cols = [*df.columns, "split"]
        assert counted(got, *cols) == counted(want, *cols), size


def test_stratified_holdout_and_folds(spark, small):
    df = table(spark)
    cols = [*df.columns, "fold"]
    ties = tie_columns(df, ["k"])
    sizes = {r["cls"]: r["count"] for r in df.groupBy("cls").count().collect()}
    before, run = {}, 0
    for c in sorted(sizes, key=lambda c: (c is not None, c)):
        before[c], run = run, run + sizes[c]
    for k in (2, 5):
        got = assign_folds(df, ["k"], k, target="cls", stratified=True)
        h = row_hash(["k"], "fold:42")
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy("cls").orderBy(h, *ties)))
        fold = F.lit(None).cast("int")
        for c, n in sizes.items():
            place = sum((F.col("_n") > e).cast("int") for e in fold_ends(n, k))
            fold = F.when(F.col("cls").eqNullSafe(F.lit(c)), (place + before[c]) % k).otherwise(fold)
        assert counted(got, *cols) == counted(ranked.withColumn("fold", fold).drop("_n"), *cols)
        counts = [r["count"] for r in got.groupBy("fold").count().collect()]
        assert len(counts) == k and max(counts) - min(counts) <= 1
    split = holdout_split(df, ["k"], "stratified_holdout", target="cls", task_type="classification", test_size=0.3)
    assert split.where("split = 'test'").count() == math.ceil(0.3 * df.count())
    plain = assign_folds(df, ["k"], 4)
    assert sorted(r["count"] for r in plain.groupBy("fold").count().collect()) == [1500] * 4


def test_few_rows(spark):
    for n in (0, 1, 3):
        df = spark.range(n).withColumn("y", F.col("id") % 2)
        assert holdout_split(df, ["id"]).where("split = 'test'").count() == math.ceil(0.2 * n)
        assert sorted(r["fold"] for r in assign_folds(df, ["id"], 5).collect()) == list(range(n))
        assert holdout_split(df, ["id"], "stratified_holdout", target="y", task_type="classification").count() == n


def test_rows_are_not_moved(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber"]
    frames = [holdout_split(li, keys), holdout_split(li, keys, "time_ordered_holdout", date_column="l_shipdate"),
              holdout_split(li, keys, "stratified_holdout", target="l_returnflag", task_type="classification"),
              assign_folds(li, keys, 5), assign_folds(li, keys, 5, target="l_returnflag", stratified=True)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert all("BroadcastExchange" in line for line in moved), plan
    narrow = holdout_split(li, keys).select("split")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in narrow and "l_extendedprice" not in narrow
