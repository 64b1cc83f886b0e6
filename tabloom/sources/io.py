"""Scans and sinks.

``load_dataset`` dispatches on the file suffix (case-insensitive):
CSV with a header and inferred types, Parquet with pushdown and pruning. Directories
of part files are accepted, on any file system that Spark reads. Float NaN is normalised to NULL once here, so every
later operator deals with a single notion of "missing".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

READABLE = (".csv", ".parquet", ".pq")

# Text tokens read as missing in CSV input (pandas read_csv defaults).
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _suffix(spark: SparkSession, path: str) -> str:
    """The path's suffix, or that of all the files in a folder; asked of the file system that the path names."""
    own = "." + path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rstrip("/").rsplit("/", 1)[-1] else ""
    if own in READABLE:
        return own
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return own
    names = [f.getPath().getName() for f in system.listStatus(place) if f.isFile()]
    kinds = {"." + n.rsplit(".", 1)[-1].lower() for n in names if "." in n and not n.startswith(("_", "."))}
    return kinds.pop() if len(kinds) == 1 else own


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL on float columns; NA tokens -> NULL on string columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.when(F.isnan(c), None).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(out)


def load_dataset(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    suffix = _suffix(spark, str(path))
    if suffix == ".csv":
        if schema is not None:
            return normalize_missing(spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(str(path)))
        raw = spark.read.option("header", True).csv(str(path))
        if not raw.columns:
            return raw
        # missing tokens become NULL before typing
        cells = [F.when(F.col(f"`{c}`").isin(list(NA_TOKENS)), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns]
        return normalize_missing(_typed(raw.select(cells)))
    if suffix in {".parquet", ".pq"}:
        df = spark.read.parquet(str(path)) if schema is None else spark.read.schema(schema).parquet(str(path))
        return normalize_missing(df)
    raise ValueError(f"Unsupported dataset format: {suffix}. Use CSV or Parquet.")


#: What a cell's text can be read as, from a narrow to a wide type; a column's evidence is the union of its cells'.
BOOLEAN, INTEGER, REAL, TEXT = 1, 2, 4, 8
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_REAL = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"


def _evidence(c: str):
    x = F.col(f"`{c}`")
    whole = F.when(F.trim(x).try_cast("bigint").isNotNull(), INTEGER).otherwise(TEXT)  # beyond 64 bits digits stay text
    return F.when(x.isNull(), 0).when(x.isin("True", "TRUE", "true", "False", "FALSE", "false"), BOOLEAN).when(x.rlike(_WHOLE), whole).when(x.rlike(_REAL), REAL).otherwise(TEXT)


def _typed(df: DataFrame) -> DataFrame:
    """Each text column as boolean, whole number, double or text: one aggregate takes the evidence of all cells. A column
    without a value is a double."""
    row = df.agg(*[F.bit_or(_evidence(c)).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    out = []
    for k, c in enumerate(df.columns):
        seen, x = row[f"c{k}"] or 0, F.col(f"`{c}`")
        if seen == BOOLEAN:
            x = F.lower(x) == "true"
        elif seen == INTEGER:
            x = F.trim(x).cast("bigint")
        elif not seen & ~(INTEGER | REAL):
            low = F.lower(F.trim(x))
            x = F.when(low.rlike("inf"), F.when(low.startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(low.try_cast("double"))
        out.append(x.alias(c))
    return df.select(out)


# ---- sinks -------------------------------------------------------------------------

def prediction_frame(scored: DataFrame, target: str, prediction_col: str = "prediction") -> DataFrame:
    """Every holdout row as ``actual, prediction``."""
    return scored.select(F.col(target).alias("actual"), F.col(prediction_col).alias("prediction"))


def prediction_preview(scored: DataFrame, target: str, key_cols: list[str], n: int = 25,
                       prediction_col: str = "prediction") -> DataFrame:
    """The first ``n`` holdout rows in key order (a top-k report)."""
    return (scored.select(*key_cols, F.col(target).alias("actual"), F.col(prediction_col).alias("prediction"))
            .orderBy(*key_cols).limit(n))


def export_predictions(scored: DataFrame, raw_columns: list[str], target: str, path: str,
                       prediction_col: str = "prediction") -> None:
    """Raw (unprepared) features + target + prediction, written as Parquet."""
    scored.select(*raw_columns, target, prediction_col).write.mode("overwrite").parquet(path)


def write_artifact(df: DataFrame, root: str, name: str, run_id: str) -> str:
    """One Parquet table per artifact, partitioned by ``run_id``. Written again, a run's part is replaced."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    return path


def commit_run(spark: SparkSession, root: str, run_id: str, tables: list[str], written_at: str) -> None:
    """The run's manifest, written when all its tables are: a run without one does not count."""
    rows = [(t, spark.read.parquet(f"{root.rstrip('/')}/{t}/run_id={run_id}").count(), written_at) for t in tables]
    write_artifact(spark.createDataFrame(rows, "artifact string, rows bigint, written_at string").coalesce(1), root, "manifest", run_id)


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a committed run, by name."""
    manifest = spark.read.parquet(f"{root.rstrip('/')}/manifest/run_id={run_id}")
    return {"manifest": manifest} | {r["artifact"]: spark.read.parquet(f"{root.rstrip('/')}/{r['artifact']}/run_id={run_id}") for r in manifest.collect()}
