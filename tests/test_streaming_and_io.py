"""Loading, saved pipelines and stream scoring."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.operators.pipeline import FittedPipeline, TabularPipeline
from tabloom.operators.profile import Brief, profile_dataset
from tabloom.plans import catalog as cat
from tabloom.plans.feature_plan import build_feature_plan
from tabloom.session import checkpoint_dir
from tabloom.sources.io import load_dataset
from tabloom.streaming.score import score_stream


def test_load_dispatch(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("a,b,c\n1,x,2.5\nNA,y,\n3,,4\n")
    df = load_dataset(spark, str(csv))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert df.where(F.col("a").isNull()).count() == 1 and df.where(F.col("c").isNull()).count() == 1
    with pytest.raises(ValueError, match="Unsupported dataset format"):
        load_dataset(spark, str(tmp_path / "t.json"))
    assert load_dataset(spark, "/root/testdata/sf0.001/region.parquet").count() == 5


def _fitted(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "user_id", "value")
    b = Brief("ev", "value", "regression")
    p, _ = profile_dataset(ev, b, key_cols=["event_id"])
    plan = build_feature_plan(p, "auto_tabular_preprocessing", {
        "drop_features": ["event_id"], "derived_feature_rules": [{"kind": "frequency_count", "source": "user_id"}]})
    pipe = TabularPipeline(plan, "regression", "ridge_regression", "value", ["event_id"], {"alpha": 1.0},
                           cat.default_training_configuration("ridge_regression", p.rows))
    return ev, pipe.fit(ev)


def test_save_load_roundtrip(spark):
    ev, fitted = _fitted(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/test_models/ridge"
    fitted.save(path)
    loaded = FittedPipeline.load(spark, path)
    a = fitted.predict(ev, ["event_id"]).orderBy("event_id").collect()
    b = loaded.predict(ev, ["event_id"]).orderBy("event_id").collect()
    assert [r["prediction"] for r in a] == pytest.approx([r["prediction"] for r in b])


def test_stream_scoring(spark, tmp_path):
    ev, fitted = _fitted(spark)
    src = tmp_path / "in"
    ev.write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))
    q = (score_stream(fitted, stream, ["event_id"]).writeStream.format("memory").queryName("scored")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM scored").first()[0] == ev.count()


def test_alignment_and_required_columns(spark):
    ev, fitted = _fitted(spark)
    without = ev.drop("event_type")
    out = fitted.prepared.transform(without).collect()
    assert all(r[c] == 0.0 for r in out for c in r.asDict() if c.startswith("event_type="))
    with pytest.raises(ValueError, match="missing required columns: event_type"):
        fitted.prepared.transform(without, require_columns=True)


def test_competition_and_standalone_validation(spark):
    from tabloom.operators.split import assign_folds, holdout_split
    from tabloom.plans.workflow import run_competition, validate
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "value")
    b = Brief("ev", "value", "regression")
    p, _ = profile_dataset(ev, b, key_cols=["event_id"])
    plan = build_feature_plan(p, "auto_tabular_preprocessing", {"drop_features": ["event_id"]})
    s = holdout_split(ev, ["event_id"])
    train, test = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    folded = assign_folds(train, ["event_id"], 3)
    board = run_competition(spark, b, p, plan, ["ridge_regression"], folded, 3, train, ["event_id"], "rmse").collect()
    assert board[0]["model"] == "ridge_regression_tuned" and board[0]["cv_value"] > 0
    pipe = TabularPipeline(plan, "regression", "ridge_regression", "value", ["event_id"], {"alpha": 1.0}, {})
    res = validate(spark, pipe.fit(train), train, test, b, ["event_id"], "rmse")
    assert res["baseline_strategy"] == "mean_value" and set(res["model_metrics"]) == {"rmse", "mae", "r2"}


def test_csv_types_by_evidence(spark, tmp_path):
    folder = tmp_path / "many.parts"
    folder.mkdir()
    (folder / "a.csv").write_text("b,i,d,t,none,big,inf,space\nTrue,1,1,1d,,1,1.5, 7\nNA,-2,2.5e3,2,NaN,99999999999999999999,-inf,8 \n")
    (folder / "b.csv").write_text("b,i,d,t,none,big,inf,space\nfalse,+3,.5,x,null,2,Infinity,9\n")
    (folder / "_SUCCESS").write_text("")
    df = load_dataset(spark, str(folder))
    assert dict(df.dtypes) == {"b": "boolean", "i": "bigint", "d": "double", "t": "string", "none": "double", "big": "string", "inf": "double", "space": "bigint"}
    rows = sorted(df.collect(), key=lambda r: r["i"])
    assert [r["b"] for r in rows] == [None, True, False] and [r["d"] for r in rows] == [2500.0, 1.0, 0.5] and [r["inf"] for r in rows] == [float("-inf"), 1.5, float("inf")]
    assert [r["space"] for r in rows] == [8, 7, 9] and all(r["none"] is None for r in rows)
    (folder / "c.json").write_text("{}")
    with pytest.raises(ValueError, match="Unsupported dataset format"):
        load_dataset(spark, str(folder))


def test_a_run_counts_when_its_manifest_is_there(spark, tmp_path):
    from tabloom.sources.io import commit_run, read_run, write_artifact
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    write_artifact(one, str(tmp_path), "t", "r1")
    with pytest.raises(Exception):
        read_run(spark, str(tmp_path), "r1")
    commit_run(spark, str(tmp_path), "r1", ["t"], "now")
    write_artifact(one.union(one), str(tmp_path), "t", "r2")
    run = read_run(spark, str(tmp_path), "r1")
    assert set(run) == {"manifest", "t"} and run["t"].count() == 1 and run["manifest"].first()["rows"] == 1
