"""Language-model scores: prediction by partial matching over bytes, beside a unigram word base.

The byte model is pretrained on the corpus. Spark counts every window of ``ORDER`` context
bytes and the byte after them over all training texts, and derives the shorter contexts
from them. Every context that was seen once belongs to the model, with all bytes seen after
it. A byte's probability comes from
the longest context of the model that precedes it: with n of the T occurrences, and D
different bytes seen there, n / (T + D), or an escape of D / (T + D) to the context that is
one byte shorter, where the bytes already seen above are excluded (escape method C); below
the empty context all unseen bytes are equally likely. A document's score is the log10
probability of its bytes (A-Z lower-cased) and of its end, which is a symbol of its own;
contexts do not cross documents.

The trie of contexts is a table of (order, context and byte, count) that grows with the corpus; a context's parent is the
context without its first byte. Two bounded parts of what follows from it are broadcast, which changes no score: the
costs of the most frequent training windows after a whole context of ``ORDER`` bytes (those that reach the least power of two
that at most ``KNOWN`` windows reach), which need the counts of that context only; and the costs of the most frequent
of the other windows (at most ``WINDOWS``). The costs of all other windows
are worked out in Spark from the whole table, order by order (``_costs``); windows beyond the second
broadcast are joined with them.

The base score is an add-one unigram model of words (see ``base``): words are counted over
all training texts. Words that make up at least one in ``FREQUENT`` training tokens (at most
that many words) are broadcast; all others are joined by their fingerprint.

Null texts are empty and consist of their end alone. With no training rows N and V are 0 and
every byte is equally likely. Rows keep their multiplicity; null ids stay; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import Fingerprints, chunks, cut_lineage, ship, word_spans

ORDER = 5
KNOWN = 1 << 19
WINDOWS = 1 << 19
FREQUENT = 1 << 22
END = 0xFF  # no byte of UTF-8


@dataclass(frozen=True)
class Model:
    train_tokens: int
    vocabulary: int
    train_docs: int
    words: np.ndarray  # fingerprints of frequent words, sorted
    counts: np.ndarray
    grams: np.ndarray  # frequent windows: ORDER context bytes and the byte after them, as one number
    costs: np.ndarray  # log10 probabilities of their last bytes
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Tables:
    words: DataFrame  # (key, n): all words by fingerprint
    grams: DataFrame  # (order, gram, n): all (context, byte) counts


def _stream(buf: np.ndarray, offs: np.ndarray):
    """The texts with ORDER ends before each one and after the last; where each text begins in it."""
    size = np.diff(offs)
    begin = offs[:-1] + ORDER * np.arange(1, len(offs))
    out = np.full(len(buf) + ORDER * len(offs), END, np.uint8)
    out[np.arange(len(buf)) + np.repeat(begin - offs[:-1], size)] = buf
    return out, begin, begin + size


def _grams(stream: np.ndarray) -> np.ndarray:
    """ORDER context bytes and the byte itself, for every place of the stream from ORDER on."""
    value = np.zeros(len(stream) - ORDER, np.int64)
    for k in range(ORDER + 1):
        value = value << 8 | stream[k:len(stream) - ORDER + k]
    return value


def _real(stream: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of these places are bytes of the texts or their ends."""
    real = np.zeros(len(stream) + 1, np.int64)
    real[begin] += 1
    real[end + 1] -= 1
    return np.cumsum(real[:-1])[ORDER:] > 0


class _Tally:
    """Counts by key, merged now and then."""

    def __init__(self, kind):
        self.keys, self.counts, self.parts = np.zeros(0, kind), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        if sum(len(p[0]) for p in self.parts) > 500_000 + len(self.keys):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[p[0] for p in self.parts]])
        counts = np.concatenate([self.counts, *[p[1] for p in self.parts]])
        self.parts = []
        self.keys, back = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(back, counts, len(self.keys)).astype(np.int64)


def _counts(training: DataFrame, text_col: str) -> DataFrame:
    """Rows (kind, key, n): kind 0 words by fingerprint, 1 byte windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, docs = _Tally(np.uint64), _Tally(np.int64), 0
        for part, buf, offs in chunks(batches, "text", lower=True):
            docs += part.num_rows
            starts, ends, _ = word_spans(buf, offs)
            words.add(Fingerprints(buf).of(starts, ends))
            stream, begin, end = _stream(buf, offs)
            grams.add(_grams(stream)[_real(stream, begin, end)])
            for kind, tally in enumerate((words, grams)):
                if len(tally.keys) > 2_000_000:
                    yield from _flush(tally, kind)
        yield from _flush(words, 0)
        yield from _flush(grams, 1)
        yield _rows(2, np.zeros(1, np.int64), np.array([docs]))

    def _rows(kind, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts)], ["kind", "key", "n"])

    def _flush(tally, kind):
        tally.merge()
        for k in range(0, len(tally.keys), 100_000):
            yield _rows(kind, tally.keys[k:k + 100_000], tally.counts[k:k + 100_000])
        tally.keys, tally.counts = tally.keys[:0], tally.counts[:0]

    text = training.select(F.col(text_col).alias("text"))
    return text.mapInArrow(run, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _least(table: DataFrame, n: str, most: int) -> int:
    """The least k such that at most ``most`` rows have n >= 2^k."""
    level = {r["level"]: r["rows"] for r in table.groupBy(F.floor(F.log2(n)).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    return next(k for k in range(65) if sum(rows for e, rows in level.items() if e >= k) <= most)


def learn(training: DataFrame, text_col: str = "text") -> tuple[Model, Tables]:
    """The model's broadcast part, and its tables."""
    ship(training.sparkSession)
    counts = cut_lineage(_counts(training, text_col))
    words = counts.where("kind = 0").select("key", "n")
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    docs = totals[2]["n"] if 2 in totals else 0
    tokens = (totals[0]["n"] if 0 in totals else 0) + docs
    distinct = (totals[0]["v"] if 0 in totals else 0) + (docs > 0)
    frequent = words.where(F.col("n") >= max(1.0, tokens / FREQUENT)).toPandas().sort_values("key", key=lambda c: c.astype(np.int64).to_numpy().view(np.uint64))
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order")
    gram = counts.where("kind = 1").select("key", "n", orders).select(
        "order", F.expr("key & (shiftleft(1L, 8 * (`order` + 1)) - 1)").alias("gram"), "n").groupBy("order", "gram").agg(F.sum("n").alias("n"))
    gram = cut_lineage(gram)
    whole = gram.where(F.col("order") == ORDER).select("gram", "n", F.shiftright("gram", 8).alias("context"))
    frequent_grams = whole.where(F.floor(F.log2("n")) >= _least(whole, "n", KNOWN))
    contexts = whole.groupBy("context").agg((F.sum("n") + F.count(F.lit(1))).alias("whole"))  # occurrences and different bytes
    known = frequent_grams.join(contexts, "context").select("gram", F.log10(F.col("n") / F.col("whole")).alias("cost")).toArrow()
    return Model(int(tokens), int(distinct), int(docs), frequent["key"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64),
                 known["gram"].to_numpy(), known["cost"].to_numpy()), Tables(words, gram)


def _costs(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (gram, cost): the log10 probability of the last byte of every ``wanted`` window (column gram), from all counts.

    At each order a row is a (context, byte) that was counted (n > 0) or is wanted; ``rest`` is the probability
    of a byte not seen after the context, after the escape from it. The bytes of a context were all seen after the
    shorter context too, so what is excluded there is known by their number and the sum of their counts there."""
    shorter = None
    context = Window.partitionBy("context")
    for order in range(ORDER + 1):
        mask = F.lit((1 << 8 * (order + 1)) - 1)
        asked = wanted.select(F.col("gram").bitwiseAND(mask).alias("gram"), F.lit(0).cast("long").alias("n"))
        rows = grams.where(F.col("order") == order).select("gram", "n").unionByName(asked).groupBy("gram").agg(F.sum("n").alias("n"))
        if order == 0:
            below = [F.lit(0).cast("long").alias("n_below"), F.lit(0).cast("long").alias("total_below"), F.lit(0).cast("long").alias("kinds_below"),
                     F.lit(None).cast("double").alias("rest_below"), F.lit(1 / 256).alias("prob_below")]
            rows = rows.select("gram", "n", *below)
        else:
            # both sides grow with the distinct windows, so both are shuffled at every size
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))).join(shorter.hint("merge"), "short").drop("short")
        rows = rows.withColumn("context", F.shiftright("gram", 8))
        seen = F.col("n") > 0
        rows = rows.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(seen.cast("long")).over(context),
                                 "excluded": F.sum(F.when(seen, F.col("n_below")).otherwise(0)).over(context)})
        left = F.col("kinds_below") - F.col("kinds")
        weight = F.col("total_below") - F.col("excluded") + left
        rest = F.lit(1.0) / F.greatest(256 - F.col("kinds"), F.lit(1)) if order == 0 else F.when(
            F.col("n_below") > 0, F.col("n_below") / weight).otherwise(F.when(weight > 0, left / weight).otherwise(1.0) * F.col("rest_below"))
        rows = rows.withColumn("rest", F.when(~seen & (F.col("total") > 0), rest))
        whole = F.col("total") + F.col("kinds")
        prob = F.when(F.col("total") == 0, F.col("prob_below")).when(seen, F.col("n") / whole).otherwise(F.col("kinds") / whole * F.col("rest"))
        shorter = rows.select(F.col("gram").alias("short"), F.col("n").alias("n_below"), F.col("total").alias("total_below"), F.col("kinds").alias("kinds_below"),
                              F.col("rest").alias("rest_below"), prob.alias("prob_below"))
    return wanted.select("gram").join(shorter.select(F.col("short").alias("gram"), F.log10("prob_below").alias("cost")).hint("merge"), "gram")


class WindowCosts:
    """Costs by window in an open-addressing table, found for many windows at once."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.bits = max(4, int(2 * len(grams)).bit_length())  # a quarter to a half full
        self.mask = (1 << self.bits) - 1
        self.keys, self.costs = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1)
        at, left = self._place(grams), np.arange(len(grams))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = grams[free]
            put = left[self.keys[at[left]] == grams[left]]
            self.costs[at[put]] = costs[put]
            left = left[self.keys[at[left]] != grams[left]]
            at[left] = (at[left] + 1) & self.mask

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows' costs (0 where unknown), and which are known."""
        at = self._place(grams)
        there = self.keys[at]
        known = there == grams
        left = np.flatnonzero(~known & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            known[left[there == grams[left]]] = True
            left = left[(there >= 0) & (there != grams[left])]
        return np.where(known, self.costs[at], 0.0), known


_MEMO: dict[str, WindowCosts] = {}


def _known(model: Model) -> WindowCosts:
    if model.tag not in _MEMO:
        _MEMO.clear()
        _MEMO[model.tag] = WindowCosts(model.grams, model.costs)
    return _MEMO[model.tag]


def base(n: Column, model: Model) -> Column:
    """log10((c + 1) / (N + V + 1)) of a token seen c times among N training tokens, V different ones."""
    return F.log10((n + 1.0) / float(model.train_tokens + model.vocabulary + 1))


def _open_windows(docs: DataFrame, shared) -> DataFrame:
    """Rows (gram, n): the distinct windows of ``docs`` (column text) that the model's frequent ones do not settle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = _known(shared.value), _Tally(np.int64)

        def flush():
            tally.merge()
            for k in range(0, len(tally.keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(tally.keys[k:k + 100_000]), pa.array(tally.counts[k:k + 100_000])], ["gram", "n"])
            tally.keys, tally.counts = tally.keys[:0], tally.counts[:0]

        for _, buf, offs in chunks(batches, "text", lower=True):
            stream, begin, end = _stream(buf, offs)
            grams = _grams(stream)[_real(stream, begin, end)]
            tally.add(grams[~known.find(grams)[1]])
            if len(tally.keys) > 2_000_000:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: Model, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = cut_lineage(_open_windows(narrow, shared))
    costs = cut_lineage(_costs(tables.grams, windows).join(windows.hint("merge"), "gram"))
    often = costs.where(F.floor(F.log2("n")) >= _least(costs, "n", WINDOWS)).select("gram", "cost").toArrow().sort_by("gram")
    held = spark.sparkContext.broadcast((often["gram"].to_numpy(), often["cost"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known_grams = _known(model)
        grams, gram_costs = held.value
        scale = np.log10(float(model.train_tokens + model.vocabulary + 1))
        for part, buf, offs in chunks(batches, "text", lower=True):
            starts, ends, doc = word_spans(buf, offs)
            keys = Fingerprints(buf).of(starts, ends)
            at = np.minimum(np.searchsorted(model.words, keys), max(len(model.words) - 1, 0))
            known = model.words[at] == keys if len(model.words) else np.zeros(len(keys), bool)
            value = np.zeros(len(keys) + 1)
            value[1:][known] = np.log10(model.counts[at[known]] + 1.0) - scale
            value, found = np.cumsum(value), np.concatenate([[0], np.cumsum(known)])
            rare = np.flatnonzero(~known)
            rare_at = np.searchsorted(rare, doc)
            lists = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(keys[rare].view(np.int64)))
            stream, begin, end = _stream(buf, offs)
            every = _grams(stream)
            cost, settled = known_grams.find(every)
            where = np.flatnonzero(_real(stream, begin, end) & ~settled)
            gram, back = np.unique(every[where], return_inverse=True)
            at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
            hit = grams[at] == gram if len(grams) else np.zeros(len(gram), bool)
            open_cost = np.zeros(len(gram))
            open_cost[hit] = gram_costs[at[hit]]
            cost[where] = open_cost[back]
            missing = ~hit[back]
            missing_at = np.append(np.searchsorted(where[missing], begin - ORDER), missing.sum())
            open_lists = pa.ListArray.from_arrays(pa.array(missing_at, pa.int32()), pa.array(gram[back][missing]))
            cost = np.concatenate([[0], np.cumsum(cost)])
            last = np.log10(model.train_docs + 1.0) - scale
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(doc) + 1), pa.array(np.diff(found[doc]) + (model.train_docs > 0)),
                 pa.array(value[doc[1:]] - value[doc[:-1]] + last), pa.array(cost[end + 1 - ORDER] - cost[begin - ORDER]), lists, open_lists],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "open"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = cut_lineage(narrow.mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, open array<bigint>"))
    rare = rows.select("row", F.explode("rare").alias("key")).join(tables.words, "key", "left").groupBy("row").agg(
        F.sum(base(F.coalesce("n", F.lit(0)), model)).alias("more"), F.count("n").alias("hits"))
    rest = rows.select("row", F.explode("open").alias("gram")).join(costs.select("gram", "cost"), "gram").groupBy("row").agg(F.sum("cost").alias("rest"))
    return rows.drop("rare", "open").join(rare, "row", "left").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))
