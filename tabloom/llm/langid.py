"""Language identification with segmentation-marginalised unigrams.

The pieces come from a fixed public SentencePiece vocabulary. Every language has a
probability for each piece, learned by expectation maximisation over *all* segmentations of
the training words; a word's likelihood under a language is the sum over all its
segmentations, found by the forward algorithm, and a text's log-likelihood is the sum over
its words. Words are maximal runs of ASCII letters and non-ASCII bytes, ASCII letters
lower-cased. A character that no piece covers has a small fixed probability.

Learning uses labelled rows (non-null text and language) only, at most ``docs_per_language``
of each language (the first by a hash of the id): a documented bound of the classifier's
sample. Everything else sees all rows and whole texts.

Null texts and texts without a letter get ``und`` with score 0, as does every text when
there are no training rows. Ties between languages go to the alphabetically first. Rows
keep their multiplicity, null ids stay, extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Fingerprints, chunks, cut_lineage, ship, word_spans

UND = "und"
MAX_PIECE = 16
LONG_WORD = 128
SCALE = 16.0  # per byte, so that products of small probabilities stay in range
UNKNOWN = 1e-7
MEMO_WORDS = 400_000

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[97:123] = False
_SEPARATORS[65:91] = False
_SEPARATORS[128:] = False


@dataclass(frozen=True)
class PieceTable:
    """Fixed pieces, sorted by fingerprint; word-initial pieces and inner pieces apart."""

    inner_keys: np.ndarray
    inner_ids: np.ndarray
    first_keys: np.ndarray
    first_ids: np.ndarray
    mark: int  # the id of the bare word mark
    size: int

    @staticmethod
    def from_vocabulary(path: str) -> PieceTable:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inner: dict[bytes, int] = {}
        first: dict[bytes, int] = {}
        mark = sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i)
            if piece == "▁":
                mark = i
                continue
            start = piece.startswith("▁")
            body = piece.removeprefix("▁").encode()
            if not body or len(body) > MAX_PIECE or "▁" in piece[1:] or _SEPARATORS[np.frombuffer(body, np.uint8)].any():
                continue
            (first if start else inner).setdefault(body.lower(), i)

        def table(d):
            body = np.frombuffer(b"".join(d), np.uint8)
            ends = np.cumsum([len(k) for k in d])
            keys = Fingerprints(body).of(np.concatenate([[0], ends[:-1]]), ends)
            order = np.argsort(keys)
            return keys[order], np.fromiter(d.values(), np.int64)[order]

        return PieceTable(*table(inner), *table(first), mark, sp.get_piece_size() + 1)

    def find(self, keys: np.ndarray, first: bool) -> np.ndarray:
        have, ids = (self.first_keys, self.first_ids) if first else (self.inner_keys, self.inner_ids)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, ids[at], -1)


def _edges(table: PieceTable, prints: Fingerprints, starts: np.ndarray, length: int):
    """For words of one length: (from, to, words, piece ids, initial) of every piece that fits."""
    for to in range(1, length + 1):
        for at in range(max(0, to - MAX_PIECE), to):
            keys = prints.of(starts + at, starts + to)
            for first in ((True, False) if at == 0 else (False,)):
                ids = table.find(keys, first)
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    yield at, to, hit, ids[hit], first


def _forward(table: PieceTable, probs: np.ndarray, edges: list, buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """alpha[word, position, language], scaled by SCALE per byte. State 0 of a word may be reached by
    its word mark (then inner pieces follow) or left by a word-initial piece."""
    alpha = np.zeros((len(starts), length + 1, probs.shape[1]))
    alpha[:, 0] = probs[table.mark]
    by_to: dict[int, list] = {}
    for e in edges:
        by_to.setdefault(e[1], []).append(e)
    for to in range(1, length + 1):
        for at, _, hit, ids, first in by_to.get(to, ()):
            step = probs[ids] * SCALE ** (to - at)
            alpha[hit, to] += step if first else alpha[hit, at] * step
        # an uncovered character: from the last position with any mass
        whole = (buf[starts + to] & 0xC0) != 0x80 if to < length else np.ones(len(starts), bool)
        dead = np.flatnonzero(whole & (alpha[:, to].max(1) <= 0))
        if len(dead):
            live = alpha[dead, :to].max(2) > 0
            back = to - 1 - live[:, ::-1].argmax(1)
            alpha[dead, to] = alpha[dead, back] * (UNKNOWN * SCALE ** (to - back))[:, None]
    return alpha


def _by_length(starts: np.ndarray, ends: np.ndarray):
    size = ends - starts
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(size[part[0]]), part


def word_scores(table: PieceTable, probs: np.ndarray, buf: np.ndarray, prints: Fingerprints, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P(word | language), all segmentations summed."""
    out = np.zeros((len(starts), probs.shape[1]))
    for length, rows in _by_length(starts, ends):
        for cut in range(0, len(rows), 20_000):
            part = rows[cut:cut + 20_000]
            edges = list(_edges(table, prints, starts[part], length))
            alpha = _forward(table, probs, edges, buf, starts[part], length)
            out[part] = np.log(np.maximum(alpha[:, length], 1e-300)) - length * np.log(SCALE)
    return out


def expected_counts(table: PieceTable, probs: np.ndarray, buf: np.ndarray, prints: Fingerprints, starts: np.ndarray, ends: np.ndarray,
                    weight: np.ndarray) -> np.ndarray:
    """Expected piece counts under all segmentations; ``weight`` is [word, language]."""
    total = np.zeros(probs.shape)
    for length, rows in _by_length(starts, ends):
        for cut in range(0, len(rows), 20_000):
            part = rows[cut:cut + 20_000]
            edges = list(_edges(table, prints, starts[part], length))
            alpha = _forward(table, probs, edges, buf, starts[part], length)
            beta = np.zeros_like(alpha)
            beta[:, length] = 1
            for at, to, hit, ids, first in sorted(edges, key=lambda e: (-e[1], -e[0])):
                # words whose alpha was bridged over an uncovered character take part up to it
                step = probs[ids] * SCALE ** (to - at)
                if not first:
                    beta[hit, at] += step * beta[hit, to]
            z = alpha[:, length]
            ok = weight[part] / np.where(z > 0, z, np.inf)
            for at, to, hit, ids, first in edges:
                step = probs[ids] * SCALE ** (to - at)
                mass = (step if first else alpha[hit, at] * step) * beta[hit, to] * ok[hit]
                for k in range(probs.shape[1]):
                    total[:, k] += np.bincount(ids, mass[:, k], probs.shape[0])
            total[table.mark] += (alpha[:, 0] * beta[:, 0] * ok).sum(0)
    return total


def _words(buf: np.ndarray, offs: np.ndarray):
    starts, ends, doc = word_spans(buf, offs, _SEPARATORS)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):  # a very long run is read in parts of at most LONG_WORD bytes, cut between characters
        s, e = [], []
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            while a < b:
                c = min(a + LONG_WORD, b)
                while c < b and c > a + 1 and buf[c] & 0xC0 == 0x80:
                    c -= 1
                s.append(a)
                e.append(c)
                a = c
        keep = ends - starts <= LONG_WORD
        starts, ends = np.concatenate([starts[keep], s]).astype(np.int64), np.concatenate([ends[keep], e]).astype(np.int64)
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
        doc = np.searchsorted(starts, offs)
    return starts, ends, doc


@dataclass(frozen=True)
class LanguageModel:
    table: PieceTable
    languages: list[str]
    probs: np.ndarray  # [piece, language]
    prior: np.ndarray  # log prior
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)


def learn(labelled: DataFrame, vocabulary_path: str, docs_per_language: int = 600, rounds: int = 2,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model of ``labelled`` rows. Driver: a matrix of pieces x languages (fixed vocabulary)."""
    spark = labelled.sparkSession
    ship(spark)
    table = PieceTable.from_vocabulary(vocabulary_path)
    from pyspark.sql import Window
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel(table, [], np.zeros((table.size, 0)), np.zeros(0))
    # the rows with the lowest hash: a threshold per language leaves a few more than the bound, the rank cuts them
    ident = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid"))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * docs_per_language / n + 30 / n)))])
    picked = rows.withColumn("h", ident).where((F.col("h").cast("double") / 2.0 ** 64 + 0.5) <= share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = picked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= docs_per_language).select("text", "lang")
    words = cut_lineage(_word_counts(picked))
    probs = np.ones((table.size, len(languages)))
    for _ in range(rounds):
        probs /= probs.sum(0)
        probs = _expected(words, table, languages, probs) + 0.1
    probs /= probs.sum(0)
    prior = np.log(np.array([counts[k] for k in languages], float) / sum(counts.values()))
    return LanguageModel(table, languages, probs, prior)


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text", lower=True):
            starts, ends, doc = _words(buf, offs)
            keys = Fingerprints(buf).of(starts, ends)
            body = buf.tobytes()
            langs = np.array(part.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                mine = np.concatenate([np.arange(doc[k], doc[k + 1]) for k in np.flatnonzero(langs == lang)])
                _, where, n = np.unique(keys[mine], return_index=True, return_counts=True)
                at = mine[where]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([body[a:b] for a, b in zip(starts[at], ends[at])], pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, table: PieceTable, languages: list[str], probs: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast((table, probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, probs = shared.value
        total = np.zeros(probs.shape)
        for part, buf, offs in chunks(batches, "word", 1 << 20):
            which = np.array([languages.index(x) for x in part.column(0).to_pylist()])
            weight = np.zeros((part.num_rows, len(languages)))
            weight[np.arange(part.num_rows), which] = part.column(2).to_numpy(zero_copy_only=False)
            total += expected_counts(table, probs, buf, Fingerprints(buf), offs[:-1], offs[1:], weight)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    got = words.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(probs.shape)
    for r in got:
        out[r["piece"], r["lang"]] = r["n"]
    return out


_MEMO: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score): the likeliest language and its posterior probability."""
    return score_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).drop("text")


def score_rows(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, buf, offs in chunks(batches, text_col, lower=True):
            pred, score = _score_chunk(model, part, buf, offs, text_col)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def _score_chunk(model: LanguageModel, part: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, text_col: str):
    n = part.num_rows
    ascii_letter = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= 97) & (buf <= 122), out=ascii_letter[1:])
    letters = (ascii_letter[offs[1:]] - ascii_letter[offs[:-1]]) > 0
    column = part.column(part.schema.get_field_index(text_col))
    for k in np.flatnonzero(~letters & (np.diff(offs) > 0)):
        letters[k] = any(c.isalpha() for c in column[int(k)].as_py())
    if not model.languages:
        return [UND] * n, np.zeros(n)
    starts, ends, doc = _words(buf, offs)
    prints = Fingerprints(buf)
    unique, where, back = np.unique(prints.of(starts, ends), return_index=True, return_inverse=True)
    owner = model.tag
    if owner not in _MEMO:
        _MEMO.clear()
        _MEMO[owner] = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))
    keys, rows = _MEMO[owner]
    if len(keys) > MEMO_WORDS:
        keys, rows = keys[:0], rows[:0]
    at = np.minimum(np.searchsorted(keys, unique), max(len(keys) - 1, 0))
    known = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
    logs = np.empty((len(unique), len(model.languages)))
    logs[known] = rows[at[known]] if len(keys) else 0
    new = np.flatnonzero(~known)
    if len(new):
        logs[new] = word_scores(model.table, model.probs, buf, prints, starts[where[new]], ends[where[new]])
        spot = np.searchsorted(keys, unique[new])
        _MEMO[owner] = np.insert(keys, spot, unique[new]), np.insert(rows, spot, logs[new], axis=0)
    total = np.zeros((len(starts) + 1, len(model.languages)))
    np.cumsum(logs[back], axis=0, out=total[1:])
    whole = total[doc[1:]] - total[doc[:-1]] + model.prior
    best = whole.argmax(1)
    top = whole[np.arange(n), best]
    score = 1 / np.exp(whole - top[:, None]).sum(1)
    pred = [model.languages[b] if ok else UND for b, ok in zip(best.tolist(), letters.tolist())]
    return pred, np.where(letters, score, 0.0)
