"""Training-corpus pipeline over ``documents``: language ID, one document per near-duplicate
group, repeated passages, benchmark leaks, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result
is written as Parquet and read again. All stages but the last return the columns of
``documents``. SQL cannot express the first and the last stage, so there is no ORACLE_SQL; the
tests hold the near-duplicate, passage and leak stages against brute force.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import automaton_dedup, bpe, decontam, langid, parity_join
from tabloom.llm.common import cut_lineage
from tabloom.llm.queries import vocabulary


SURE = 0.5  # of the posterior probability
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(stage):
    """``stage`` with Arrow batches of 4 MB at most, unless the session says otherwise: of each batch every task holds several
    copies off the heap and one in Python, and Spark's 64 MB let whole partitions of texts be one batch. The operators work
    through a batch in slices of 1 MB, so nothing else depends on its size."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if BATCH not in spark.conf.getAll:
            spark.conf.set(BATCH, "4m")
        return stage(spark, docs, sf_dir)
    return run


def _columns(docs: DataFrame) -> list:
    """The columns by name, whatever the name holds."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _aside(docs: DataFrame, stay: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with all columns but ``stay`` under names that clash with nothing (Spark hands no dotted names to Python
    tasks), and the columns that bring the names back."""
    names = {c: c if c in stay else f"__column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def _key(*names: str):
    """A number of 63 bits for a row's values, from a digest of them."""
    text = F.to_json(F.array(*[F.col(c).cast("string") for c in names]))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


@_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told stay; those without a letter (``und``) go, and those for which no
    language has ``SURE`` of the posterior probability."""
    model = langid.learn(docs, vocabulary("piece_bpe_32k.model"))
    if not model.languages:  # no row says its language: nothing can be told, nothing goes
        return docs
    plain, back = _aside(docs, ("text",))
    return plain.transform(langid.score_rows, model).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= SURE)).select(*back)


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on 5-word shingles, the document with the smallest id stays (then the least hash of id and
    text). Rows of one id with different texts are different documents; of rows with the same id and text the one
    with the least other columns stays. Rows without an id stay."""
    keyed = docs.where("doc_id is not null").select(*_columns(docs), _key("doc_id", "text").alias("__key"))
    groups = parity_join.near_duplicates(keyed, 5, 80, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    first = keyed.select("__key", "doc_id").distinct().join(groups, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first"))
    kept = keyed.join(first.select("first.__key"), "__key", "left_semi")
    # of equal ids and texts the row whose values as text come first: any type of column will do. The text, which is equal, travels once
    row = F.struct(*[F.when(F.col("text").isNotNull(), "").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    kept = kept.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    kept = kept.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null")).select(*_columns(docs))


@_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words that an earlier document holds too are cut out of the text."""
    plain, back = _aside(docs.withColumn("n_chars", F.lit(None).cast("long")), ("doc_id", "text", "n_chars"))
    return automaton_dedup.remove_repeats(plain, 13).withColumn("n_chars", F.char_length("text").cast("long")).select(*back).select(*_columns(docs))


@_small_batches
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go. What leaked is told by the text's hash: ids can be null
    or stand on several rows."""
    keyed = docs.select(*_columns(docs), _key("text").alias("__key"))
    leaks = decontam.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    leaked = leaks.select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(leaked, "__key", "left_anti").select(*_columns(docs))


@_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as digests."""
    return bpe.digests(bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe_round_trip", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
