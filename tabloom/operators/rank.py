"""Exact distributed rank (K1).

``row_number()`` over a window without ``partitionBy`` pulls every row into one
task. Instead rows are cut into *buckets* that are monotone in the sort order:

* ``hash`` order: the sort key is a uniform 60-bit row hash, so the bucket is simply
  its top bits;
* ``range`` order (e.g. time): buckets come from approximate quantiles of the sort
  key. Every quantile boundary value gets a bucket of its own, and a value that
  holds many rows (one timestamp carrying a third of the table) is split further
  by the row hash, which is the tie-breaker anyway, so no bucket outgrows a task.

One small aggregate counts rows per (partition, bucket, sub-bucket); cumulative
offsets over that count table (bounded by partitions x buckets, checked) are
joined back, and ``row_number()`` inside each bucket plus the offset gives the
exact global rank. The result equals a single-partition ``row_number()`` ordered
by (sort key, tie columns) within each partition group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import HASH_BITS

ROWS_PER_BUCKET = 1 << 20   # rows one window task sorts at most (until MAX_BUCKETS)
MAX_BUCKETS = 1 << 20       # 10^12 rows -> ~1M rows per bucket; the offset table stays <= 1M rows per class
MAX_RANGE_BITS = 16         # range order: at most 2^16 quantile buckets (heavy values are split further)
BROADCAST_ROWS = 2_000_000  # offsets are broadcast only below this many rows, else joined by shuffle
MAX_GROUPS = 100_000


def _nbits(n: int, rows_per_bucket: int, parallelism: int = 1) -> int:
    """Bucket bits: enough that no bucket exceeds ``rows_per_bucket`` rows, and at
    least about two buckets per core so the per-bucket sort is never one task."""
    want = max(1, math.ceil(n / max(rows_per_bucket, 1)), 2 * max(parallelism, 1))
    return min(int(math.ceil(math.log2(want))), int(math.log2(MAX_BUCKETS)))


def exact_rank(df: DataFrame, sort_key: Column, tie_cols: Sequence[str | Column], *,
               partition_cols: Sequence[str] = (), order: str = "hash", tie_hash: Column | None = None,
               rank_col: str = "_rank", n_rows: int | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Append ``rank_col`` (1-based) = position of each row ordered by
    (sort_key, *tie_cols) within ``partition_cols``.

    ``order="hash"``: ``sort_key`` must be uniform on [0, 2**60).
    ``order="range"``: ``sort_key`` is a non-null BIGINT; ``tie_hash`` (uniform
    60-bit, first tie column) splits heavy single values.
    """
    spark = df.sparkSession
    part = list(partition_cols)
    d = df.withColumn("_sk", sort_key)
    if n_rows is None:
        n_rows = d.count()
    bits = _nbits(n_rows, rows_per_bucket, spark.sparkContext.defaultParallelism)

    if order == "hash":
        d = d.withColumn("_b", F.shiftright(F.col("_sk"), HASH_BITS - bits) if bits else F.lit(0).cast("bigint"))
        d = d.withColumn("_sub", F.lit(0).cast("bigint"))
    elif order == "range":
        if tie_hash is None:
            raise ValueError("range order needs tie_hash to split heavy values")
        # range buckets from approximate quantiles (exactness comes from the counts, so
        # uneven buckets only cost balance); the sketch is sized to the bucket count
        nq = 1 << min(max(bits, 0), MAX_RANGE_BITS)
        if nq > 1:
            probs = [i / nq for i in range(1, nq)]
            accuracy = int(min(max(10_000, 10 * nq), 1_000_000))
            qs = d.agg(F.percentile_approx(F.col("_sk"), probs, accuracy).alias("q")).collect()[0]["q"] or []
        else:
            qs = []
        # boundary value -> how many quantile slots it covers (a heavy value repeats)
        reps: dict[int, int] = {}
        for q in qs:
            reps[int(q)] = reps.get(int(q), 0) + 1
        bounds = sorted(reps)
        # splits -inf, b1, b1+1, b2, b2+1, ..., +inf: up to 2^53 [b, b+1) holds exactly the
        # integer value b, so every boundary value is a bucket of its own; beyond, buckets are
        # still monotone. Bucketizer finds the bucket by binary search inside the JVM.
        if bounds:
            from pyspark.ml.feature import Bucketizer
            splits = sorted({float(x) for b in bounds for x in (b, b + 1)})
            splits = [float("-inf")] + splits + [float("inf")]
            d = d.withColumn("_skd", F.col("_sk").cast("double"))
            d = Bucketizer(splits=splits, inputCol="_skd", outputCol="_bd").transform(d)
            d = d.withColumn("_b", F.col("_bd").cast("bigint")).drop("_skd", "_bd")
            # A heavy value is split by the tie hash. Doubles cannot tell large neighbours apart, so the
            # value itself is compared as BIGINT: smaller rows of the bucket come first, then its own
            # splits, then the larger ones.
            heavy: dict[int, list[tuple[int, int]]] = {}
            for b in bounds:
                if reps[b] >= 2:
                    heavy.setdefault(splits.index(float(b)), []).append((b, max(1, int(math.ceil(math.log2(reps[b] + 1))))))
            sub = F.lit(0).cast("bigint")
            for bid, values in heavy.items():
                base, inner = 0, None
                for b, sb in values:
                    below, own = F.col("_sk") < F.lit(b).cast("bigint"), F.col("_sk") == F.lit(b).cast("bigint")
                    split = F.lit(base + 1) + F.shiftright(tie_hash, HASH_BITS - sb)
                    inner = (F.when(below, F.lit(base)) if inner is None else inner.when(below, F.lit(base))).when(own, split)
                    base += 1 + (1 << sb)
                sub = F.when(F.col("_b") == F.lit(bid), inner.otherwise(F.lit(base))).otherwise(sub).cast("bigint")
            d = d.withColumn("_sub", sub)
        else:
            d = d.withColumn("_b", F.lit(0).cast("bigint")).withColumn("_sub", F.lit(0).cast("bigint"))
    else:
        raise ValueError(f"unknown order {order!r}")

    keys = part + ["_b", "_sub"]
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).collect()
    if len(counts) > MAX_GROUPS * (1 << bits):
        raise ValueError("too many rank groups; reduce the number of partitions")

    # cumulative offsets per partition group, in (bucket, sub) order: computed over
    # the bounded count table
    def pkey(r):
        return tuple((r[c] is not None, r[c]) for c in part)

    counts.sort(key=lambda r: (pkey(r), r["_b"], r["_sub"]))
    offsets, running, last = [], 0, None
    for r in counts:
        k = pkey(r)
        if k != last:
            running, last = 0, k
        offsets.append(tuple(r[c] for c in part) + (r["_b"], r["_sub"], running))
        running += r["_n"]
    schema_fields = [d.schema[c] for c in part]
    from pyspark.sql.types import LongType, StructField, StructType
    off_schema = StructType(schema_fields + [StructField("_b", LongType()), StructField("_sub", LongType()),
                                             StructField("_off", LongType())])
    off_df = spark.createDataFrame(offsets, off_schema)
    if len(offsets) <= BROADCAST_ROWS:
        off_df = F.broadcast(off_df)
    cond = [d[c].eqNullSafe(off_df[c]) for c in part] + [d["_b"] == off_df["_b"], d["_sub"] == off_df["_sub"]]
    joined = d.join(off_df, cond, "inner").select(d["*"], off_df["_off"])
    w = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(F.col("_sk"), *[F.col(c) if isinstance(c, str) else c for c in tie_cols])
    ranked = joined.withColumn(rank_col, F.col("_off") + F.row_number().over(w))
    return ranked.drop("_sk", "_b", "_sub", "_off")
