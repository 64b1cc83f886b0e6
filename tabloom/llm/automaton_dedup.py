"""Repeated passages: suffix automata of reference documents and matching statistics.

A window is ``min_words`` consecutive words of one document (words are unchanged). A word is
removed when a window that covers it has its word sequence in a document with a smaller id
too. Windows are judged on the input, not on what is left.

Every window chooses one of its short shingles, the first one with the least hash. Equal windows choose
equal shingles, so documents that share a window share a chosen shingle; the first document
with a shingle is the reference of all others that have it. The references are the shards:
the stretches of a document that hold windows of a shared shingle travel to that shingle's reference, where the suffix
automaton of the reference gives their matching statistics, and the windows that end
where at least ``min_words`` words match are removed. (The automata of all references together
grow with the corpus, so they are not broadcast: a reference's text is sorted before the stretches that
ask for it and travels once, or once more for every ``ASKS`` shingles that others share with it.) A window that its reference
does not hold can only be shared with other documents of the same shingle that failed
likewise; these few are matched among themselves by 96-bit fingerprints, streamed in order.

Null texts have no words. Ids are expected to be unique; rows that share an id do not count
as smaller than each other, and each loses the words that either loses by position. Rows with
a null id are neither references nor changed. Other columns are handed through; columns
called ``n_words`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabloom.llm.common import Fingerprints, chunks, cut_lineage, drop, keep, mix64, release, ship, word_spans

SHINGLE = 4
ASKS = 10_000
U = np.uint64


def _sequences(words: np.ndarray, n: int, salt: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each place on where n words follow, or from the places ``at``."""
    h = np.full(max(len(words) - n + 1, 0) if at is None else len(at), salt, U)
    for k in range(n):
        h = mix64(h * U(0x9E3779B97F4A7C15) + (words[k:k + len(h)] if at is None else words[at + k]))
    return h


def chosen(words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the shingle hash that each one chooses."""
    if len(words) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, U)
    size = min(SHINGLE, min_words)
    h = _sequences(words, size)
    spread = np.lib.stride_tricks.sliding_window_view(h, min_words - size + 1)
    starts = np.arange(len(spread))
    owner = np.searchsorted(doc, starts, "right") - 1
    inside = starts + min_words <= doc[owner + 1]
    starts = starts[inside]
    return starts, spread[starts].min(1)


class SuffixAutomaton:
    """Suffix automaton of one word sequence; words are integers."""

    def __init__(self, words: list[int]):
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for w in words:
            state = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in edges[p]:
                edges[p][w] = state
                p = link[p]
            if p >= 0:
                q = edges[p][w]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[state] = copy
                    while p >= 0 and edges[p].get(w) == q:
                        edges[p][w] = copy
                        p = link[p]
            last = state
        self.edges, self.link, self.length = edges, link, length

    def statistics(self, words: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        edges, link, length = self.edges, self.link, self.length
        state, size, out = 0, 0, []
        for w in words:
            to = edges[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = edges[state].get(w)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def _shingles(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (key, doc_id): the shingles that a document's windows choose, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            starts, ends, doc = word_spans(buf, offs)
            at, key = chosen(Fingerprints(buf).of(starts, ends), doc, min_words)
            if not len(at):
                continue
            owner = np.searchsorted(doc, at, "right") - 1
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[new], owner[new]
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[owner[new]])], ["key", "doc_id"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint")


def _later(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Rows whose key an earlier document has too, with that first document as ``first``. The keys come sorted, with the ids
    in order; only the last key and its first document are remembered."""
    columns = [*keys, "doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(keys))], 1)
            doc = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]).any(1)
            hubs = doc[first]
            if last is not None and (key[0] == last).all():
                hubs[0] = hub
            own = hubs[np.cumsum(first) - 1]
            last, hub = key[-1], own[-1]
            out = pa.array(doc > own)
            yield pa.RecordBatch.from_arrays([c.filter(out) for c in batch.columns] + [pa.array(own).filter(out)], [*columns, "first"])

    schema = StructType([*rows.select(*columns).schema.fields, StructField("first", LongType())])
    return rows.select(*columns).repartition(keys[0]).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, schema)


def _asked(texts: DataFrame, min_words: int) -> DataFrame:
    """Rows (first, part, doc_id, low, windows, text): the stretches of a document's words that hold windows to be looked up
    in the reference ``first``; ``low`` is the number of the stretch's first word, ``windows`` are window starts within it.
    ``texts``: (doc_id, text, asked), ``asked`` a list of (key, first, more) in any order; all that a document asks
    of a reference goes to one ``part``, 0 to ``more``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text"):
            starts, ends, doc = word_spans(buf, offs)
            at, key = chosen(Fingerprints(buf).of(starts, ends), doc, min_words)
            bounds = np.searchsorted(at, doc)
            body = buf.tobytes()
            lists = part.column(2)
            list_at = lists.offsets.to_numpy()
            wanted = lists.flatten().field("key").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            wanted_first = lists.flatten().field("first").to_numpy(zero_copy_only=False)
            wanted_more = lists.flatten().field("more").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = part.column(0).to_pylist()
            dealt = mix64(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)) >> U(1)
            out: list[tuple] = []
            for row in range(part.num_rows):
                a, b = list_at[row] - list_at[0], list_at[row + 1] - list_at[0]
                order = np.argsort(wanted[a:b])
                keys, firsts, mores = wanted[a:b][order], wanted_first[a:b][order], wanted_more[a:b][order]
                own = slice(bounds[row], bounds[row + 1])
                spot = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                hit = np.flatnonzero(keys[spot] == key[own])
                if not len(hit):
                    continue
                place, first, more = at[own][hit], firsts[spot[hit]], mores[spot[hit]]
                order = np.lexsort((place, first))
                place, first, more = place[order], first[order], more[order]
                cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(place) > min_words)) + 1
                for c, d in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                    low, high = int(place[c]), int(place[d - 1]) + min_words - 1
                    out.append((int(first[c]), int(dealt[row]) % (int(more[c]) + 1), ids[row], low - int(doc[row]), (place[c:d] - low).astype(np.int32).tobytes(),
                                body[starts[low]:ends[high]].decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                                                 ["first", "part", "doc_id", "low", "windows", "text"])

    return texts.mapInArrow(run, "first bigint, part int, doc_id bigint, low bigint, windows binary, text string")


def _against_references(asked: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, start, stop, h1, h2): runs of window starts found in their reference (h1 null), and
    single windows not found in it. ``asked``: rows of _asked, those of one (first, part) together and after their reference's
    text, whose row has no doc_id (texts that share the reference's id are all looked in)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, references, automaton = None, [], None
        for part, buf, offs in chunks(batches, "text", 1 << 19):
            starts, ends, doc = word_spans(buf, offs)
            words = Fingerprints(buf).of(starts, ends)
            firsts, parts, ids, lows, lists = (part.column(k).to_pylist() for k in range(5))
            out: list[tuple] = []
            lost: list[tuple[int, int, int]] = []  # the document, the window's number there and its place in the chunk
            for row in range(part.num_rows):
                base, own = int(doc[row]), words[doc[row]:doc[row + 1]].tolist()
                if (firsts[row], parts[row]) != now:
                    now, references, automaton = (firsts[row], parts[row]), [], None
                if ids[row] is None:
                    if own not in references:
                        references.append(own)
                    continue
                if automaton is None:  # -1 is no word
                    automaton = SuffixAutomaton([w for reference in references for w in (*reference, -1)])
                place = np.frombuffer(lists[row], np.int32).astype(np.int64)
                stat = np.array(automaton.statistics(own))
                found = stat[place + min_words - 1] >= min_words
                hit = place[found] + lows[row]
                if len(hit):
                    for r in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                        out.append((ids[row], int(r[0]), int(r[-1]) + 1, None, None))
                lost += [(ids[row], p + lows[row], p + base) for p in place[~found].tolist()]
            if lost:
                at = np.array([x[2] for x in lost])
                h1, h2 = (_sequences(words, min_words, salt, at) for salt in (1, 2))
                out += [(i, p, p + 1, a, b) for (i, p, _), a, b in zip(lost, h1.view(np.int64).tolist(), (h2 >> U(33)).tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                                                 ["doc_id", "start", "stop", "h1", "h2"])

    return asked.mapInArrow(run, "doc_id bigint, start bigint, stop bigint, h1 bigint, h2 int")


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, runs): the starts of a document's removed windows as [start, stop) runs of word numbers."""
    docs = docs.where("doc_id is not null and text is not null")
    later = keep(_later(_shingles(docs, min_words), ["key"], []))
    wide = later.groupBy("first").agg((F.count(F.lit(1)) / ASKS).cast("int").alias("more")).where("more > 0")  # a row for ASKS shared shingles at most
    firsts = later.join(F.broadcast(wide), "first", "left").select("key", "doc_id", "first", F.coalesce("more", F.lit(0)).alias("more"))
    no_ask = F.lit(None).cast("struct<key:bigint,first:bigint,more:int>")
    roles = firsts.select("doc_id", F.struct("key", "first", "more").alias("ask"), F.lit(None).cast("int").alias("copies")).union(
        firsts.select("first", "more").distinct().select("first", no_ask, "more"))
    roles = roles.groupBy("doc_id").agg(F.collect_set("ask").alias("asked"), F.max("copies").alias("copies"))  # at most a document's windows
    release(docs.sparkSession)
    texts = keep(docs.join(roles, "doc_id").select("doc_id", "text", "asked", "copies"))  # the only shuffle of whole texts by their own id
    drop(later)
    asked = _asked(texts.where(F.size("asked") > 0).select("doc_id", "text", "asked"), min_words)
    references = texts.where("copies is not null").select(F.col("doc_id").alias("first"), F.explode(F.sequence(F.lit(0), "copies")).alias("part"), "text")
    asked = asked.unionByName(references, allowMissingColumns=True)  # references without a doc_id, so they come first
    asked = asked.repartition("first", "part").sortWithinPartitions("first", "part", "doc_id")
    found = cut_lineage(_against_references(asked, min_words))
    drop(texts)
    among = _later(found.where("h1 is not null"), ["h1", "h2"], ["start", "stop"])
    runs = found.where("h1 is null").select("doc_id", "start", "stop").unionByName(among.select("doc_id", "start", "stop"))
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))


def remove_repeats(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of repeated windows removed from the text (kept words joined by one space; a text that
    loses nothing stays as it is), and n_words and n_removed added."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeated_windows(narrow, min_words)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).join(runs.select(F.col("doc_id").alias("__id"), F.col("runs").alias("__runs")), F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left").drop("__id")
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text_col):
            starts, ends, doc = word_spans(buf, offs)
            removed = np.zeros(part.num_rows, np.int64)
            texts = part.column(place).to_pylist()
            body = None
            for row, own in enumerate(part.column(len(columns)).to_pylist()):
                if not own:
                    continue
                n = int(doc[row + 1] - doc[row])
                cover = np.zeros(n + 1, np.int64)
                for r in own:
                    cover[min(r["start"], n)] += 1
                    cover[min(r["stop"] + min_words - 1, n)] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                removed[row] = int(gone.sum())
                if removed[row]:
                    body = buf.tobytes() if body is None else body
                    left = np.flatnonzero(~gone) + doc[row]
                    texts[row] = b" ".join([body[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())]).decode()
            out = [pa.array(texts, pa.string()) if k == place else part.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(doc)), pa.array(removed)], [*columns, "n_words", "n_removed"])

    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in columns]).schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(run, schema)
