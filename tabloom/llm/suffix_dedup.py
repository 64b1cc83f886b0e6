"""Repeated byte strings: distributed prefix doubling.

Every text is its UTF-8 bytes. A byte is removed when a string of ``threshold`` bytes that covers
it also starts anywhere else, in the same document too; overlaps count, matches never cross
documents, and strings are judged on the input.

Positions. Of all positions only the *anchors* are ranked: in every window of w neighbouring
positions the first one whose next eight bytes have the least hash. The choice depends on
the window's bytes alone, so both copies of a repeated string have the same anchors inside,
and w is small enough that four phrases (the bytes from one anchor to the next) follow the first
anchor within the string.

Doubling. An anchor's first rank names its phrase. Spark sorts the pairs (rank at the anchor, rank
one phrase on), then (new rank at the anchor, new rank two phrases on); equal pairs get the same new rank,
and an anchor whose pair is unique leaves. Ranks are 64-bit names, as only equality counts. What is left after the
last doubling is near the threshold in length, and the sort goes on with exact byte lengths: the
``threshold`` - w + 1 bytes from the anchor, which all strings of its window positions have in common;
then the whole stretch that these strings cover, whose repetition proves them all; and
only for anchors next to the end of a repeat, string by string. Sorted runs are streamed
with a bounded state; no group is collected.

Names and fingerprints have 62 bits while candidates are searched and 93, from three independent lanes, where strings are held equal.

Null and empty texts have no bytes. Rows that are equal in id and text are copies of each
other like any others. Null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import Fingerprints, chunks, cut_lineage, drop, keep, mix64, ship

GRAM = 8
PHRASES = 4
U = np.uint64
_LOW = U(0xFFFFFFFF)


def window_of(threshold: int) -> int:
    """The largest w such that PHRASES phrases fit: (threshold - 2 w - 6) / w >= PHRASES."""
    return (threshold - 6) // (PHRASES + 2)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    size, out = 1, x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(buf: np.ndarray, offs: np.ndarray, threshold: int):
    """(anchor, document, first and last start of the strings that choose it or -1, first anchor of each document)."""
    w = window_of(threshold)
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < threshold:
        return none, none, none, none, np.zeros(len(offs), np.int64)
    grams = np.ndarray(n - GRAM + 1, "<u8", np.ascontiguousarray(buf), strides=(1,))
    x = (mix64(grams) & ~_LOW) | np.arange(len(grams), dtype=U)
    pick = (_least(x, w) & _LOW).astype(np.int64)  # of the window that begins at each position
    change = np.ones(len(pick), bool)
    change[1:] = pick[1:] != pick[:-1]
    bounds = offs[1:-1][offs[1:-1] < len(pick)]
    change[bounds] = True
    # windows that reach beyond their document choose nothing
    gap = w + GRAM - 2
    reach = np.minimum(np.diff(offs), gap)
    beyond = np.repeat(offs[1:] - np.cumsum(reach), reach) + np.arange(reach.sum())
    change[beyond[beyond < len(pick)]] = False
    low = np.flatnonzero(change)
    doc = np.searchsorted(offs, low, "right") - 1
    at = pick[low]
    high = np.minimum(np.append(low[1:] - 1, n)[:len(low)], offs[doc + 1] - threshold)  # a later document's first start is behind that
    return at, doc, np.where(high >= low, low, -1), high, np.searchsorted(doc, np.arange(len(offs)))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column in one array, and the row of each; a null holds none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _bounds(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of an array of runs."""
    return tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in runs.flatten())


def _first_pairs(docs: DataFrame, threshold: int) -> DataFrame:
    """Rows (pair, row, i): the names of the anchors' first and second phrase, as one name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            at, doc, low, _, begin = anchors(buf, offs, threshold)
            if not len(at):
                continue
            prints = Fingerprints(buf)
            phrase = np.zeros(len(at), U)
            phrase[:-1] = prints.of(at[:-1], np.maximum(at[1:], at[:-1]))
            mine = np.flatnonzero(np.arange(len(at)) + 2 < begin[doc + 1])  # the last ones are needed as others' second half
            pair = mix64(phrase[mine] * U(0x9E3779B97F4A7C15) + phrase[mine + 1])
            rows = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(rows[doc[mine]]), pa.array((mine - begin[doc[mine]]).astype(np.int32))], ["pair", "row", "i"])

    return docs.mapInArrow(run, "pair bigint, row bigint, i int")


def _repeated(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """The rows whose key occurs more than once; keys come sorted, and the last row is withheld until the next one is seen."""
    columns = [*keys, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False  # the last row, and whether its key has been repeated already
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([table.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(keys))], 1)
            same = (key[1:] == key[:-1]).all(1)
            out = np.zeros(len(key), bool)
            out[1:] |= same
            out[:-1] |= same
            out[0] |= known
            known = bool(out[-1])
            held = table.slice(len(key) - 1, 1)
            out[-1] = False
            if out.any():
                yield table.filter(pa.array(out))
        if held is not None and known:
            yield held

    picked = rows.select(*columns)
    return picked.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, picked.schema)


def _stretches(asked: DataFrame, threshold: int) -> DataFrame:
    """Rows (core, lo, hi, f1, f2, row, start) of the wanted anchors: the name of what their strings have in common, how far
    the strings begin before the anchor, and the fingerprint of all that they cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            at, doc, low, high, begin = anchors(buf, offs, threshold)
            wanted = np.zeros(len(at), bool)
            own, k = _flat(part.column(2))
            wanted[begin[k] + own.to_numpy(zero_copy_only=False)] = True
            mine = np.flatnonzero(wanted & (low >= 0))
            a, lo, hi = at[mine], low[mine], high[mine]
            prints = Fingerprints(buf)
            core = prints.of(a, a + threshold - window_of(threshold) + 1)
            f1, f2 = _two(prints, lo, hi + threshold)
            rows = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array((a - lo).astype(np.int32)), pa.array((a - hi).astype(np.int32)), pa.array(f1), pa.array(f2),
                                              pa.array(rows[doc[mine]]), pa.array(lo - offs[doc[mine]])], ["core", "lo", "hi", "f1", "f2", "row", "start"])

    return asked.mapInArrow(run, "core bigint, lo int, hi int, f1 bigint, f2 int, row bigint, start bigint")


def _two(prints: Fingerprints, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """93 bits of the strings, from three lanes."""
    return prints.of(a, b).view(np.int64), prints.spare(a, b)


def _judged(stretches: DataFrame) -> DataFrame:
    """Rows (row, start, lo, hi, proven): anchors whose whole stretch is repeated (proven), and of every
    core with different stretches one anchor for each different stretch (proven or not), to be looked at string by string."""
    names = ["core", "lo", "hi", "f1", "f2", "row", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 9  # rows of the last core, with what has been put out of them
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)]
            cols = [np.concatenate([h, c]) for h, c in zip(held, [*cols, np.zeros(len(cols[0]), np.int64), np.zeros(len(cols[0]), np.int64)])]
            n = len(cols[0])
            new_core = np.ones(n, bool)
            new_core[1:] = cols[0][1:] != cols[0][:-1]
            new = new_core.copy()
            for c in cols[1:5]:
                new[1:] |= c[1:] != c[:-1]
            stretch, core = np.cumsum(new) - 1, np.cumsum(new_core) - 1
            repeated = np.bincount(stretch)[stretch] > 1
            several = (np.bincount(core[new]) > 1)[core]
            proven = repeated & (cols[7] == 0)
            look = new & several & (cols[8] == 0)
            cols[7] |= proven
            cols[8] |= look
            put = proven | look
            kind = np.where(proven, 1, 0) | np.where(look, 2, 0)
            yield pa.RecordBatch.from_arrays([pa.array(cols[5][put]), pa.array(cols[6][put]), pa.array(cols[1][put].astype(np.int32)), pa.array(cols[2][put].astype(np.int32)),
                                              pa.array(kind[put].astype(np.int32))], ["row", "start", "lo", "hi", "kind"])
            stay = np.flatnonzero(core == core[-1])[:1]
            tail = np.flatnonzero(stretch == stretch[-1])[:2]
            stay = np.unique(np.concatenate([stay, tail]))
            held = [c[stay] for c in cols]

    parts = stretches.select(*names).repartition("core").sortWithinPartitions("core", "lo", "hi", "f1", "f2")
    return parts.mapInArrow(run, "row bigint, start bigint, lo int, hi int, kind int")


def _strings(asked: DataFrame, threshold: int) -> DataFrame:
    """Rows (f1, f2, row, p): all strings of the stretches listed in ``own``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            prints = Fingerprints(buf)
            rows = part.column(0).to_numpy(zero_copy_only=False)
            runs, k = _flat(part.column(2))
            start, stop = _bounds(runs)
            ends = np.cumsum(stop - start)
            for c in range(0, int(ends[-1]) if len(ends) else 0, 200_000):
                place = np.arange(c, min(c + 200_000, ends[-1]))
                own = np.searchsorted(ends, place, "right")
                q, o = stop[own] - (ends[own] - place) + offs[k[own]], k[own]
                f1, f2 = _two(prints, q, q + threshold)
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array(rows[o]), pa.array(q - offs[o])], ["f1", "f2", "row", "p"])

    return asked.mapInArrow(run, "f1 bigint, f2 int, row bigint, p bigint")


def repeated_strings(docs: DataFrame, threshold: int) -> DataFrame:
    """Rows (row, runs): starts of repeated strings of ``threshold`` bytes as [start, stop) runs. ``docs``: (row, text)."""
    docs = docs.where(F.octet_length("text") >= threshold)
    ranks = _repeated(_first_pairs(docs, threshold), ["pair"], ["row", "i"])
    offset = 2
    while offset < PHRASES:
        # the pair (rank here, rank ``offset`` phrases on); the latter is among the next rows if it is not unique
        along = Window.partitionBy("row").orderBy("i")
        nexts = F.array(*[F.struct(F.lead("i", k).over(along).alias("i"), F.lead("pair", k).over(along).alias("pair")) for k in range(1, offset + 1)])
        ranks = ranks.groupBy("row", "i", "pair").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("times"))  # rows equal in id and text
        ranks = ranks.select("row", "i", "pair", "times", nexts.alias("nexts"))
        ranks = ranks.select("row", "i", "pair", "times", F.expr(f"filter(nexts, s -> s.i = i + {offset})").alias("on")).where("size(on) > 0").select(
            F.xxhash64("pair", F.col("on")[0]["pair"]).alias("pair"), "row", "i", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
        ranks = _repeated(ranks, ["pair"], ["row", "i"])
        offset *= 2
    lists = cut_lineage(ranks.groupBy("row").agg(F.collect_set("i").alias("own")))  # at most a document's anchors
    texts = keep(docs.join(lists, "row").select("row", "text", "own"))
    judged = keep(_judged(_stretches(texts, threshold)))
    span = [F.col("start"), (F.col("start") + F.col("lo") - F.col("hi") + 1).alias("stop")]
    looked = judged.where("kind >= 2").groupBy("row").agg(F.collect_set(F.struct(*span)).alias("own"))
    strings = _strings(texts.select("row", "text").join(looked, "row").select("row", "text", "own"), threshold)
    single = cut_lineage(_repeated(strings, ["f1", "f2"], ["row", "p"]).select("row", "p"))
    runs = cut_lineage(judged.where("kind in (1, 3)").select("row", *span).unionByName(single.select("row", F.col("p").alias("start"), (F.col("p") + 1).alias("stop"))))
    drop(texts, judged)
    return runs.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))


def remove_repeats(docs: DataFrame, threshold: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` holds the remaining bytes."""
    if window_of(threshold) < 2:
        raise ValueError("the threshold is too small")
    ship(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(repeated_strings(rows.select("row", "text"), threshold), "row", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            runs, k = _flat(part.column(2))
            start, stop = _bounds(runs)
            cover = np.bincount(offs[k] + start, minlength=len(buf) + 1) - np.bincount(np.minimum(offs[k] + stop + threshold - 1, offs[k + 1]), minlength=len(buf) + 1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            first = gone.copy()
            inner = offs[1:-1][offs[1:-1] < len(buf)]
            first[1:] &= ~gone[:-1]
            first[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(first)])
            removed = total[offs[1:]] - total[offs[:-1]]
            body, at = buf[~gone].tobytes(), offs - total[offs]
            kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans[offs[1:]] - spans[offs[:-1]]), kept],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
