"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@_register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the labelled rows outside the held-out fold."""
    from tabloom.llm import langid
    docs = _documents(spark, sf_dir)
    model = langid.learn(docs.where(_fold(3) != 1), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


@_register
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text, as digests."""
    from tabloom.llm import bpe
    return bpe.digests(bpe.encode_decode(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


@_register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labelled rows outside the held-out fold."""
    from tabloom.llm import toxicity
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels.where(_fold(5) != 0))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_register
def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram scores of every whole text, learned from the texts outside the held-out fold."""
    from tabloom.llm import ppm
    docs = _documents(spark, sf_dir)
    model, words = ppm.learn(docs.where(_fold(7) != 2))
    return ppm.score(docs, model, words).select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_register
def op6_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all ``embeddings`` at cosine 0.98."""
    from tabloom.llm import embed_join
    return embed_join.range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


@_register
def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 0.9."""
    from tabloom.llm import parity_join
    return parity_join.near_duplicates(_documents(spark, sf_dir), 3, 90)


@_register
def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words taken out of all documents but the first with each."""
    from tabloom.llm import automaton_dedup
    kept = automaton_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), 13)
    # kept words joined by one space, in texts that lost nothing too
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@_register
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes taken out of every whole text."""
    from tabloom.llm import suffix_dedup
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that leaked into each document."""
    from tabloom.llm import decontam
    return decontam.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_register
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 512 BPE ids in a keyed order, written as fixed-stride shards."""
    from tabloom.llm import training_order
    return training_order.materialise(_documents(spark, sf_dir), training_order.shared_folder(spark), vocabulary_path=vocabulary("byte_bpe_50k.json"))


@_register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal periodic runs of words of every whole text, after a tenth of the documents were made periodic by rule."""
    from tabloom.llm import periodic_runs
    found = periodic_runs.find_runs(_made_periodic(_documents(spark, sf_dir)), 12, digest=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Texts of documents with h % 10 = 0, h the crc32 of the id, whose word i >= a becomes word a + (i - a) % p."""
    made = """transform(transform(array(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), w -> struct(w, cast((h div 10) % size(w) as int) as a)),
        s -> concat_ws(' ', slice(s.w, 1, s.a), slice(flatten(array_repeat(
            slice(s.w, s.a + 1, cast(1 + (size(s.w) - s.a) div (3 + (h div 10) % 8) as int)), cast(3 + (h div 10) % 8 as int))), 1, size(s.w) - s.a)))[0]"""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    planted = F.when((F.col("h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.expr(made)).otherwise(F.col("text"))
    return hashed.select("doc_id", planted.alias("text"))


@_register
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, and the records read back from them."""
    from tabloom.llm import warc_archive
    pages, place = spark.read.parquet(f"{sf_dir}/pages.parquet"), warc_archive.archive_folder(spark)
    warc_archive.write_archive(pages, place)
    kind = pages.schema["page_id"].dataType.simpleString()
    return warc_archive.read_archive(spark, place, kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op13_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""


@_register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, after every 7th vector's label was moved on by one."""
    from tabloom.llm import hard_negatives
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
           FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
           FROM p JOIN s USING (anchor_id)
           WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
