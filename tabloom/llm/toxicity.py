"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Text is folded first: case, homoglyphs (Latin look-alikes of other scripts, accents kept) and
digits or signs that stand for letters inside a word (digits at its start too); what else is not a letter separates
words. Lexicon entries are whole words and word beginnings, both anchored at the word's
start; each has a weight, the log-odds of being found in toxic against other texts among
the labelled training rows. An exception phrase is an entry with the word before or after it
that training shows to be no sign of toxicity (it is found mostly in other texts); its
occurrences cancel the entry's weight. Per text the entries' weights are summed, each
occurrence once with the longest entry, normalised by length (weight per square root of
the number of words, and the largest weight), and a logistic function fitted on the
training rows turns both into a score.

Learning uses at most ``max_rows`` labelled rows per class (lowest hash of the id first): a
documented bound of the classifier's sample. Scoring sees all whole texts.

Null and empty texts get the score of a text without matches. Without training rows of both
classes every score is the toxic share seen (0 if none). Rows keep their multiplicity; null
ids stay; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import chunks, cut_lineage, ship

#: Look-alike letters, and digits and signs read as letters between letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһӏɡɑοαενικρτυᴀʙᴄᴅᴇ", "aeopcyxijsdhlgaoaevikptuabcde")
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
PREFIX_MIN, PREFIX_MAX = 3, 8


def fold_map() -> dict[int, str]:
    """One character to one: lower case, homoglyphs, full-width forms; what is no letter, digit or
    leet sign becomes a space."""
    out = {}
    for code in range(0x3000):
        c = chr(code)
        low = c.lower() if len(c.lower()) == 1 else c
        low = low.translate(HOMOGLYPHS)
        out[code] = low if low.isalpha() or low in LEET else " "
    for code in range(0xFF01, 0xFF5F):
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        out[code] = c if c.isalpha() or c in LEET else " "
    for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF):
        out[code] = ""
    return out


_FOLD = fold_map()
_SIGNS = str.maketrans({c: v for c, v in LEET.items()})


def fold(text: str) -> str:
    """Words of letters, a single space before each and after the last. A digit or sign counts as a
    letter inside a word, a digit also before it; else it falls away."""
    words = text.translate(_FOLD).split()
    out = []
    for w in words:
        if not w.isalpha():
            w = w.lstrip("@$!").rstrip("013457@$!")
            if not w.isalpha():
                w = w.translate(_SIGNS)
        if w:
            out.append(w)
    return " " + " ".join(out) + " " if out else " "


@dataclass(frozen=True)
class Lexicon:
    """``weights`` by entry: " word " for a whole word, " beg" for a beginning. ``exceptions``: folded phrases."""

    weights: dict[str, float]
    exceptions: list[str]
    intercept: float = -3.0
    per_length: float = 1.0
    per_peak: float = 1.0
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)


def sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of each class, those with the lowest hash of their id."""
    from pyspark.sql import Window
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * max_rows / n + 50 / n)))])
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("toxic"))
    near = labelled.withColumn("h", h).where((F.col("h").cast("double") / 2.0 ** 64 + 0.5) <= share[F.col("toxic")])
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))).where(F.col("rank") <= max_rows).drop("h", "rank")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon of the rows of ``docs`` that ``labels`` marks 0 or 1 (a row with several labels counts
    with the highest). Null labels are left out."""
    ship(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    picked = sample(ids.join(marks, "doc_id", "left_semi").distinct().join(marks, "doc_id"), max_rows)
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id"))  # at most 2 x max_rows ids
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        share = size.get(1, 0) / max(1, sum(size.values()))
        return Lexicon({}, [], math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches, "text"):
            found: dict[tuple[str, int], int] = {}
            for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                own = set()
                for w in set(fold(text).split()):
                    own.add(f" {w[:40]} ")
                    own.update([" " + w[:k] for k in range(PREFIX_MIN, min(PREFIX_MAX, len(w) - 1) + 1)])
                for f in own:
                    found[f, toxic] = found.get((f, toxic), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["entry", "toxic", "n"])

    rows = rows.select("doc_id", "text", "toxic")
    odds = rows.mapInArrow(features, "entry string, toxic int, n bigint").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (size[1] + 1.0)) - F.log((F.col("good") + 0.5) / (size[0] + 1.0))
    # entries in min_docs toxic texts of the bounded sample and with clear odds: bounded by the sample
    strong = odds.where(f"bad >= {min_docs}").withColumn("w", weight).where("w >= 1.5").collect()
    weights = _minimal({r["entry"]: (r["w"], r["bad"], r["good"]) for r in strong})
    exceptions = _exceptions(rows, weights, size)
    return _fit(rows, Lexicon(weights, exceptions), size)


def _minimal(entries: dict[str, tuple[float, int, int]]) -> dict[str, float]:
    """Longer entries go when a shorter one covers them about as well."""
    kept: dict[str, tuple[float, int, int]] = {}
    for e in sorted(entries, key=len):
        body = e.rstrip()
        shorter = [body[:k] for k in range(2, len(body))] + ([body] if e != body else [])
        if not any(s in kept and kept[s][0] >= entries[e][0] - 0.7 for s in shorter):
            kept[e] = entries[e]
    for e in [e for e in kept if not e.endswith(" ")]:
        whole = e + " "
        if whole in entries and entries[whole][1] >= 0.9 * kept[e][1]:
            kept[whole] = entries[whole]
            del kept[e]
    return {e: v[0] for e, v in kept.items()}


def _automaton(lexicon: Lexicon):
    import ahocorasick
    a = ahocorasick.Automaton()
    for e, w in lexicon.weights.items():
        a.add_word(e, (len(e), w))
    for phrase in lexicon.exceptions:
        a.add_word(phrase, (len(phrase), None))
    a.make_automaton()
    return a


_MEMO: dict[str, object] = {}


def matches(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """Weights of the entries found in a text, outside exception phrases, and its number of words."""
    if lexicon.tag not in _MEMO:
        _MEMO.clear()
        _MEMO[lexicon.tag] = _automaton(lexicon) if lexicon.weights else None
    auto, folded = _MEMO[lexicon.tag], fold(text)
    if auto is None:
        return [], folded.count(" ") - 1
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in auto.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif start not in best or size > best[start][0]:
            best[start] = size, weight
    if excused:
        best = {s: v for s, v in best.items() if not any(a <= s and s + v[0] - 1 <= b for a, b in excused)}
    return [w for _, w in best.values()], folded.count(" ") - 1


def _exceptions(rows: DataFrame, weights: dict[str, float], size: dict[int, int]) -> list[str]:
    """Two-word phrases with a whole-word entry that are found in other texts at least as often, by share, as in
    toxic ones, and in at least three texts."""
    whole = {e for e in weights if e.endswith(" ")}
    if not whole:
        return []

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches, "text"):
            found: list[tuple[str, int]] = []
            for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = fold(text).split()
                own = {f" {a} {b} " for a, b in zip(words, words[1:]) if f" {a} " in whole or f" {b} " in whole}
                found += [(p, toxic) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["phrase", "toxic"])

    n = rows.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(
        (F.sum(F.col("toxic")) / size[1]).alias("bad"), (F.sum(1 - F.col("toxic")) / size[0]).alias("good"), F.count(F.lit(1)).alias("n"))
    return [r["phrase"] for r in n.where("n >= 3 and good >= bad").collect()]


def _features(found: list[float], words: int) -> tuple[float, float]:
    return sum(found) / math.sqrt(max(words, 1)), max(found, default=0.0)


def _fit(rows: DataFrame, lexicon: Lexicon, size: dict[int, int]) -> Lexicon:
    """Two-feature logistic regression by Newton steps on the bounded sample's features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in chunks(batches, "text"):
            got = [_features(*matches(t or "", lexicon)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), part.column(2)], ["a", "b", "toxic"])

    got = rows.mapInArrow(run, "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"])  # two numbers a sampled row
    x = np.column_stack([np.ones(len(got)), got["a"], got["b"]])
    y = got["toxic"].to_numpy(float)
    weight = np.where(y == 1, 1.0, 1.0)
    beta = np.array([-2.0, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.01 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, float(beta[0]), float(beta[1]), float(beta[2]))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, n_matches)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for part, _, _ in chunks(batches, "text"):
            got = [matches(t or "", lexicon) for t in part.column(1).to_pylist()]
            x = np.array([_features(*g) for g in got])
            p = 1 / (1 + np.exp(-(lexicon.intercept + lexicon.per_length * x[:, 0] + lexicon.per_peak * x[:, 1])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array([len(g[0]) for g in got], pa.int32())], ["doc_id", "score", "n_matches"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double, n_matches int")
