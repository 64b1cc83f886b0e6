"""Shared helpers: NumPy views of Arrow text columns, word boundaries, substring
fingerprints, lineage cuts, and shipping the package to the executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import checkpoint_dir, cut_lineage

__all__ = ["Fingerprints", "array_bytes", "binary_column", "checkpoint_dir", "chunks", "cut_lineage", "drop", "keep", "mix64",
           "release", "ship", "word_spans", "with_text"]

U64 = np.uint64
CHUNK_BYTES = 1 << 20

#: The prime 2^31 - 1, a base of large order for each lane and its inverse, and a random value per lane and byte.
_PRIME = (1 << 31) - 1
_BASES = [1389796, 972439182, 1500450271]
_BYTE_VALUES = np.random.RandomState(20240229).randint(1, _PRIME, (3, 256), dtype=np.int64).astype(U64)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application, through Spark's own
    file distribution (as ``--py-files`` does)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="tabloom-src-")) / "tabloom_src.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def keep(df: DataFrame, compression: str | None = None) -> DataFrame:
    """cut_lineage that remembers where the table lies, for ``drop``; with ``compression``, the table's codec."""
    if compression is None:
        out = cut_lineage(df)
    else:
        path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(path)
        out = df.sparkSession.read.parquet(path)
    out.table_files = out.inputFiles()[:1]
    return out


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so when the driver's garbage
    collector finds that nothing refers to them, which on a quiet driver can take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``keep`` that no later step reads, and release finished shuffles."""
    for df in tables:
        for name in df.table_files:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    release(tables[0].sparkSession)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def array_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, col.offset + n + 1)[col.offset:].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES,
           lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` (one row at least),
    with that column's bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, offs = array_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            part = buf[offs[i]:offs[j]]
            yield batch.slice(i, j - i), _ASCII_LOWER[part] if lower else part, offs[i:j + 1] - offs[i]
            i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray | None = None):
    """Words, maximal runs without the bytes 0x20 and 0x09-0x0D (or without ``separators``,
    a boolean table over bytes): their starts, ends, and each document's first word.
    Words never cross documents."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    if separators is None:
        text = (buf != 32) & ((buf < 9) | (buf > 13))
    else:
        text = ~separators[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = text[:-1]
    starts = np.flatnonzero(text & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = text[1:]
    ends = np.flatnonzero(text & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Fingerprints:
    """Fingerprints of substrings of one byte buffer: polynomials over random byte values modulo 2^31 - 1, in two
    lanes with bases of their own (62 bits together), so any substring's value comes from prefix sums. A third lane,
    ``spare``, is only worked out where it is asked for. The modulus is a prime, so regular strings
    (Thue-Morse words, say, which agree modulo 2^64 for every base) are told apart like any others."""

    _powers: dict[tuple[int, bool], np.ndarray] = {}

    @classmethod
    def _power(cls, lane: int, inverse: bool, n: int) -> np.ndarray:
        """The base's powers 0..n-1, or those of its inverse; made by doubling and kept."""
        have = cls._powers.get((lane, inverse))
        if have is None or len(have) < n:
            base = pow(_BASES[lane], -1, _PRIME) if inverse else _BASES[lane]
            out = np.ones(max(n, CHUNK_BYTES + 1), np.uint32)
            size = 1
            while size < len(out):
                more = min(size, len(out) - size)
                out[size:size + more] = out[:more].astype(U64) * U64(pow(base, size, _PRIME)) % U64(_PRIME)
                size += more
            have = cls._powers[lane, inverse] = out
        return have

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self.sums = [self._lane(0), self._lane(1)]

    def _lane(self, lane: int) -> np.ndarray:
        n = len(self.buf)
        term = _BYTE_VALUES[lane][self.buf]
        term *= self._power(lane, False, n + 1)[:n]
        high = term >> U64(31)
        term &= U64(_PRIME)
        term += high  # below 2^32 and right modulo the prime
        sums = np.zeros(n + 1, U64)
        np.cumsum(term, out=sums[1:])
        return sums

    def _values(self, lane: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = self.sums[lane]
        return (sums[b] - sums[a]) % U64(_PRIME) * self._power(lane, True, len(self.buf) + 1)[a] % U64(_PRIME)

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._values(0, a, b) << U64(31) | self._values(1, a, b)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of the substrings [a, b)."""
        return mix64(self.raw(a, b) + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))

    def spare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """31 further bits, from a lane of their own."""
        if len(self.sums) < 3:
            self.sums.append(self._lane(2))
        return self._values(2, a, b).astype(np.int32)


def binary_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of a binary column: consecutive runs of ``values``, ``counts`` of them each."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def with_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that clashing extra columns do no harm."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
