"""Pipeline stages on columns of any type and name; embeddings that share an id."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import embed_join

SF = "/root/testdata/sf0.001"


def test_stages_with_maps_dotted_names_and_clashes(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = para(80), para(90)
    rows = [(1, a, "en", {"k": 1}, 0.5, "x", 7), (1, a, "en", {"k": 2}, 0.5, "x", 7), (2, a, "en", None, 0.1, "y", 8), (3, b, "fr", {}, 0.2, "z", 9), (4, "123 !!", "en", {}, 0.3, "z", 9),
            (None, b, "fr", {"n": 1}, 0.0, "q", 1), (5, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, tags map<string,int>, score double, lang_pred string, `a.b` int").repartition(2)
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["score"], r["lang_pred"]) for r in kept.collect()) == [
        (0, 0.0, "q"), (1, 0.5, "x"), (1, 0.5, "x"), (2, 0.1, "y"), (3, 0.2, "z")]
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    got = [(r["doc_id"], r["tags"], r["a.b"]) for r in one.collect()]
    assert one.columns == docs.columns and sorted(got, key=repr) == sorted([(1, {"k": 1}, 7), (3, {}, 9), (None, {"n": 1}, 1)], key=repr)
    left = corpus_pipeline.benchmark_leaks(spark, corpus_pipeline.repeated_passages(spark, one.drop("tags").withColumn("n_chars", one["doc_id"]), SF), SF)
    assert left.count() == 3 and "a.b" in left.columns
    silent = spark.createDataFrame([(1, a, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, silent, SF).count() == 1


def test_embeddings_that_share_an_id(spark):
    near = lambda x, y: [float(x), float(y), 0.001]
    rows = [(1, near(1, 0), 0), (1, near(0, 1), 0), (2, near(1, 0.01), 0), (3, near(0.01, 1), 0), (4, near(-1, 0), 0), (4, near(-1, 0), 0)]
    got = embed_join.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]


def test_stages_bound_arrow_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.createDataFrame([(1, "a text", "en", 6)], "doc_id long, text string, lang string, n_chars long")
    large = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    try:
        spark.conf.unset(corpus_pipeline.BATCH)
        assert corpus_pipeline.benchmark_leaks(spark, docs, SF).count() == 1
        assert max(r["n"] for r in large.mapInArrow(sizes, "n long").collect()) < 6 << 20
        spark.conf.set(corpus_pipeline.BATCH, "9m")  # the session's own choice stays
        corpus_pipeline.benchmark_leaks(spark, docs, SF)
        assert spark.conf.getAll[corpus_pipeline.BATCH] in ("9m", f"{9 << 20}b")
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)
