"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The benchmark's items are an inverted index: per term the items that hold it with their BM25
impact, divided by the score of the item against itself, so that an item found word for word
scores 1. The index is built in shards of at most ``SHARD_ITEMS`` items and
``SHARD_BYTES`` bytes of text (document frequencies count all items); each shard is broadcast, and the training
documents are streamed against it.

Every text is cut into overlapping passages of twice the longest item, so each occurrence of an item
lies wholly in one passage. A passage is the query. All items that score ``threshold`` or more are
retrieved, without loss, by block-max pruning: first, for all passages at once, the sums of the terms'
maxima per block of neighbouring items; for passages with a block that may reach the threshold, block-max
WAND over the postings. Retrieved items are verified on word n-grams: the question and the answer must both be found in
the passage to ``overlap`` or more. The answer is the item's last line if it has several, else its
last third; n is 5, or the part's length if that is less.

Words are maximal runs of ASCII letters and digits and non-ASCII bytes, A-Z lower-cased. Null and
empty texts and items have no passages; items that repeat are all reported; rows with a null item
id are ignored, documents with a null id are reported as such. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Fingerprints, chunks, mix64, ship, word_spans

SHARD_ITEMS = 2048
SHARD_BYTES = 4 << 20
ITEM_BLOCK = 4
POSTING_BLOCK = 16
NGRAM = 5
K1, B = 1.2, 0.75
U = np.uint64

_SEPARATORS = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SEPARATORS[_low:_high] = False


def _words(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode().lower(), np.uint8)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]), _SEPARATORS)
    return Fingerprints(buf).of(starts, ends)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(len(words) - n + 1, 0), U)
    for k in range(n):
        h = mix64(h * U(0x9E3779B97F4A7C15) + words[k:k + len(h)])
    return h


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of an item's question and of its answer."""
    lines = [w for w in (_words(x) for x in text.split("\n")) if len(w)]
    words = np.concatenate(lines) if lines else np.zeros(0, U)
    cut = len(words) - len(lines[-1]) if len(lines) > 1 else len(words) - len(words) // 3
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Shard:
    """An inverted index of some items. Item numbers are places in ``ids``."""

    ids: list[int]
    parts: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray  # sorted fingerprints
    postings: list[tuple[list[int], list[float], list[float], list[int]]]  # items, impacts; per block the largest impact and last item
    most: np.ndarray  # [term, item block]: largest impact
    stride: int
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)


def build_shard(items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean_length: float, stride: int) -> Shard:
    parts = [question_and_answer(t) for _, t in items]
    lists: dict[int, list[tuple[int, float]]] = {}
    for k, (q, a) in enumerate(parts):
        words = np.concatenate([q, a])
        terms, tf = np.unique(words, return_counts=True)
        df = np.array([frequency[int(t)] for t in terms.view(np.int64)], float)
        gain = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
        for t, g in zip(terms.tolist(), (gain / gain.sum()).tolist()):
            lists.setdefault(t, []).append((k, g))
    terms = np.array(sorted(lists), U)
    postings = []
    most = np.zeros((len(terms), -(-len(items) // ITEM_BLOCK)), np.float32)
    for row, t in enumerate(terms.tolist()):
        own, gain = [p[0] for p in lists[t]], [p[1] for p in lists[t]]
        cuts = range(0, len(own), POSTING_BLOCK)
        postings.append((own, gain, [max(gain[c:c + POSTING_BLOCK]) for c in cuts], [own[min(c + POSTING_BLOCK, len(own)) - 1] for c in cuts]))
        np.maximum.at(most[row], np.array(own) // ITEM_BLOCK, np.array(gain, np.float32))
    return Shard([i for i, _ in items], parts, terms, postings, most, stride)


class _Cursor:
    def __init__(self, posting):
        self.items, self.gains, self.block_most, self.block_last = posting
        self.at, self.block = 0, 0
        self.most = max(self.block_most)
        self.item = self.items[0]

    def seek(self, item: int) -> None:
        """To the first posting of ``item`` or later; past the end the item is larger than any."""
        at, items = self.at, self.items
        while at < len(items) and items[at] < item:
            at += 1
        self.at = at
        self.item = items[at] if at < len(items) else 1 << 60

    def shallow(self, item: int) -> tuple[float, int]:
        """Largest impact and last item of the block that may hold ``item``."""
        while self.block < len(self.block_last) and self.block_last[self.block] < item:
            self.block += 1
        if self.block == len(self.block_last):
            return 0.0, 1 << 60
        return self.block_most[self.block], self.block_last[self.block]


def block_max_wand(shard: Shard, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least ``threshold`` for a query of distinct terms."""
    least = threshold - 1e-9
    cursors = [_Cursor(shard.postings[t]) for t in terms]
    out = []
    while True:
        cursors = sorted([c for c in cursors if c.at < len(c.items)], key=lambda c: c.item)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c.most
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            return out
        item = cursors[pivot].item
        while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
            pivot += 1
        blocks = [c.shallow(item) for c in cursors[:pivot + 1]]
        if sum(b[0] for b in blocks) >= least:
            if cursors[0].item == item:
                score = sum(c.gains[c.at] for c in cursors[:pivot + 1])
                if score >= least:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
        else:
            to = min(b[1] for b in blocks) + 1
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1].item)
            to = max(to, item + 1) if cursors[0].item == item else max(to, item)
            if to <= item:
                to = item + 1
        for c in cursors[:pivot + 1]:
            if c.item < to:
                c.seek(to)


def _search(shard: Shard, threshold: float, overlap: float, buf: np.ndarray, offs: np.ndarray):
    """(document, item, score, question overlap, answer overlap) of every verified retrieval."""
    starts, ends, doc = word_spans(buf, offs, _SEPARATORS)
    if not len(starts) or not len(shard.terms):
        return
    words = Fingerprints(buf).of(starts, ends)
    row = np.minimum(np.searchsorted(shard.terms, words), len(shard.terms) - 1)
    row = np.where(shard.terms[row] == words, row, -1)
    # half passages of ``stride`` words; a passage is a half and the next one of its document
    owner = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    halves = -(-np.diff(doc) // shard.stride)
    first = np.concatenate([[0], np.cumsum(halves)])
    half = first[owner] + (np.arange(len(words)) - doc[owner]) // shard.stride
    known = row >= 0
    pair = np.unique(half[known] * len(shard.terms) + row[known])
    at_half, at_row = pair // len(shard.terms), pair % len(shard.terms)
    bound = np.zeros((first[-1] + 1, shard.most.shape[1]), np.float32)
    begin = np.flatnonzero(np.diff(at_half, prepend=-1))
    for c in range(0, len(begin), 4096):
        stop = begin[c + 4096] if c + 4096 < len(begin) else len(pair)
        cut = begin[c:c + 4096]
        bound[at_half[cut]] = np.add.reduceat(shard.most[at_row[cut[0]:stop]], cut - cut[0], axis=0)
    whose = np.repeat(np.arange(len(halves)), halves)
    joined = bound[:-1].copy()
    both = np.append(whose[1:] == whose[:-1], False) if len(whose) else np.zeros(0, bool)
    joined[both] += bound[:-1][1:][both[:-1]] if len(whose) > 1 else 0
    for k in np.flatnonzero((joined >= threshold - 1e-4).any(1)).tolist():
        d = int(whose[k])
        low = int(doc[d]) + (k - int(first[d])) * shard.stride
        high = min(low + 2 * shard.stride, int(doc[d + 1]))
        terms = np.unique(row[low:high])
        found = block_max_wand(shard, terms[terms >= 0].tolist(), threshold)
        if not found:
            continue
        passage: dict[int, np.ndarray] = {}
        for item, score in found:
            shares = []
            for part in shard.parts[item]:
                n = min(NGRAM, len(part))
                if not n:
                    shares.append(1.0)
                    continue
                if n not in passage:
                    passage[n] = np.unique(_grams(words[low:high], n))
                shares.append(float(np.isin(np.unique(_grams(part, n)), passage[n]).mean()))
            if min(shares) >= overlap:
                yield d, shard.ids[item], score, shares[0], shares[1]


def _shards(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size, one list at a time on the driver."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    now: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("id", "text").toLocalIterator():
        if now and (len(now) >= SHARD_ITEMS or size + len(r["text"]) > SHARD_BYTES):
            yield now
            now, size = [], 0
        now.append((r["id"], r["text"]))
        size += len(r["text"])
    if now:
        yield now


def _term_statistics(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (term, n): in how many items each term is; the lengths of the items come under a null term, as (null, words)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches, "text"):
            term, n = [], []
            for text in part.column(1).to_pylist():
                words = _words(text)
                own = np.unique(words).view(np.int64).tolist()
                term += [None, *own]
                n += [len(words)] + [1] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    return rows.mapInArrow(run, "term bigint, n bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap): for each document and item found in it the best passage."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    statistics = _term_statistics(benchmark, item_id_col, item_text_col)
    size = statistics.where("term is null and n > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    stride = max(64, size["longest"] or 0)
    found = spark.createDataFrame([], schema)
    for items in _shards(benchmark, item_id_col, item_text_col):
        items = [(i, t) for i, t in items if len(_words(t))]
        if not items:
            continue
        own = sorted({int(w) for _, t in items for w in _words(t).view(np.int64)})  # at most SHARD_BYTES of words
        terms = spark.createDataFrame([(t,) for t in own], "term bigint")
        frequency = {r["term"]: r["df"] for r in statistics.join(terms, "term").groupBy("term").agg(F.sum("n").alias("df")).collect()}
        shared = spark.sparkContext.broadcast(build_shard(items, frequency, size["n"], size["mean"], stride))
        found = found.unionByName(_scan(narrow, shared, threshold, overlap, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


def _scan(docs: DataFrame, shared, threshold: float, overlap: float, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for part, buf, offs in chunks(batches, "text", lower=True):
            got = list(_search(shard, threshold, overlap, buf, offs))
            if got:
                ids = part.column(0).to_pylist()
                doc, *rest = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array(rest[0], pa.int64()), *[pa.array(c, pa.float64()) for c in rest[1:]]],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(run, schema)
