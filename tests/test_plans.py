"""Plan properties: the rank window is partitioned by bucket, no Python
row UDF runs in the core, and pruned columns reach the Parquet scan."""

from __future__ import annotations

import re

import pytest

CORE_JOBS = ["split_random", "split_time_ordered", "kfold_stratified", "prepare_matrix", "frequency_count",
             "scale_standard", "baseline_stratified_random"]


def _plan(spark, name):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, "/root/testdata/sf0.01")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE_JOBS)
def test_no_python_udf_and_partitioned_windows(spark, name):
    plan = _plan(spark, name)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan
    # every Window over data is fed by a hash-partitioned exchange, never SinglePartition
    for block in re.split(r"\n(?=\s*[:+]- Window )", plan)[1:]:
        following = block.split("Exchange", 1)
        if len(following) > 1:
            assert not following[1].lstrip().startswith("SinglePartition"), plan


def test_scan_reads_only_needed_columns(spark):
    from pyspark.sql import functions as F
    from tabloom.jobs import fixtures as fx
    li = fx.table(spark, "/root/testdata/sf0.01", "lineitem")
    plan = li.select("l_quantity", "l_discount").agg(F.sum(F.col("l_quantity") * F.col("l_discount")))._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema.count(":") == 2


def test_profile_counts_features_and_target_in_one_scan(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from tabloom.operators.profile import Brief, profile_dataset
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda d: (lambda rows: plans.append(d._jdf.queryExecution().executedPlan().toString()) or rows)(collect(d)))
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    profile, _ = profile_dataset(orders, Brief("p", "o_orderpriority", "classification"), key_cols=["o_orderkey"])
    assert profile.target_cardinality == 5 == len(profile.class_counts)
    counted = next(p for p in plans if "Union" in p)
    final = counted.split("== Initial Plan ==")[0]
    assert final.count("Generate") == 1 and final.count("FileScan parquet") == 1 and "ReusedExchange" in final, final
