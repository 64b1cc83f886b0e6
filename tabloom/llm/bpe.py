"""Byte-level BPE encoding and decoding.

Text is cut at added special tokens, then into short words by the byte-level
pre-tokenisation pattern. Each short word is merged with a contiguous rank array: the
word's parts and the merge rank of every adjacent pair lie side by side; the array is
scanned for its minimum, that boundary is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. Words of more than ``LONG_WORD`` bytes use the same
merges through a heap, so a text without spaces costs n log n.

A Python worker keeps the encodings of pieces of text it has met in byte pools (a memo bounded in pieces and bytes,
emptied when full), so known pieces are copied in bulk. Pieces are looked up by fingerprint; as the bytes
that a piece's ids stand for are the piece itself, every hit is then held against the text byte by byte, and a text with a wrong hit is
encoded by itself. The vocabulary file is read on the driver and broadcast; its size
is that of the file. Decoding joins the bytes of the ids and reads them as UTF-8, replacing
malformed sequences.

Null texts are empty; an empty text has no ids. Rows keep their multiplicity; a null id is
returned as it is. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Fingerprints, chunks, ship, with_text

LONG_WORD = 256
MEMO_PIECES = 600_000
MEMO_BYTES = 48 << 20
_NONE = 1 << 62

#: The pre-tokenisation pattern of byte-level BPE, with Unicode's White_Space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    if it is printable Latin-1, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer is expected")
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.token = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.byte_id = [ids[c] for c in letters]
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_rank[ids[a] << 24 | ids[b]] = rank
            self.merged.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token.update({i: s.encode() for s, i in self.special.items()})
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.words = regex.compile(PATTERN)
        keys = np.fromiter(self.pair_rank, np.int64, len(self.pair_rank))
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.ranks = np.fromiter(self.pair_rank.values(), np.int64, len(keys))[order]
        self.merged_ids = np.array(self.merged, np.int64)
        self.bytes_to_ids = np.array(self.byte_id, np.int64)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one short word."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._encode_long(parts)
        rank_of, merged = self.pair_rank.get, self.merged
        ranks = [rank_of(a << 24 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 24 | parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 24 | parts[at + 1], _NONE)
        return parts

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """encode_word for many words: the rank arrays of words of one length are rows of a
        matrix, and each step deletes one boundary in every row that still has a ranked pair."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, members in by_length.items():
            if length > LONG_WORD or len(members) < 8:
                for k in members:
                    out[k] = self.encode_word(words[k])
                continue
            raw = np.frombuffer(b"".join([words[k] for k in members]), np.uint8).reshape(-1, length)
            parts = self.bytes_to_ids[raw]
            size = np.full(len(members), length)
            ranks = np.full((len(members), length), _NONE)
            if length > 1:
                ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
            cols, rows = np.arange(length), np.arange(len(members))
            while len(rows):
                sub = ranks[rows]
                at = sub.argmin(1)
                least = sub[np.arange(len(rows)), at]
                go = least < _NONE
                rows, at, least, sub = rows[go], at[go], least[go], sub[go]
                if not len(rows):
                    break
                here = np.arange(len(rows))
                own = np.take_along_axis(parts[rows], np.minimum(cols + (cols > at[:, None]), length - 1), 1)
                own[here, at] = self.merged_ids[least]
                sub = np.take_along_axis(sub, np.minimum(cols + (cols >= at[:, None]), length - 1), 1)
                sub[:, -1] = _NONE
                size[rows] -= 1
                left, right = at > 0, at + 1 < size[rows]
                sub[here[left], at[left] - 1] = self._rank(own[here[left], at[left] - 1], own[here[left], at[left]])
                sub[here, at] = _NONE
                sub[here[right], at[right]] = self._rank(own[here[right], at[right]], own[here[right], at[right] + 1])
                parts[rows], ranks[rows] = own, sub
            for k, own, n in zip(members, parts.tolist(), size.tolist()):
                out[k] = own[:n]
        return out

    def _encode_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank_of = self.pair_rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i] << 24 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j] = self.merged[rank], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank_of(parts[x] << 24 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, live) if ok]

    def _plain(self, text: str) -> list[int]:
        return [i for word in self.words.findall(text) for i in self.encode_word(word.encode())]

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token[i] for i in ids]).decode("utf-8", "replace")


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each document and at each space between two visible characters,
    where a short word always begins. What may be other white space counts as not visible."""
    n = len(buf)
    plain = (buf > 32) & (buf < 127)
    two = np.zeros(n, bool)  # last byte of a two-byte character that is not white space
    two[1:] = (buf[:-1] > 0xC2) & (buf[:-1] < 0xE0)
    lead = (buf > 0xC2) & ((buf < 0xE0) | (buf > 0xE3))
    at = np.zeros(n + 1, bool)
    at[1:n - 1] = (buf[1:-1] == 32) & (plain | two)[:-2] & (plain | lead)[2:]
    edge = offs[(offs > 0) & (offs < n)]
    at[edge - 1] = at[edge] = False  # the neighbours must be of the same document
    at[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(at[:n])


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes texts in bulk. Pieces of text are known by length, first bytes and fingerprint;
    what is kept per piece lies in byte pools: the ids (as decimal text with commas, or two or four bytes
    each) and the bytes that they decode to."""

    def __init__(self, vocabulary: Vocabulary, csv: bool):
        self.vocabulary, self.csv = vocabulary, csv
        self.width = 2 if max(vocabulary.token) < 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.heads = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.counts = _Pool(np.int64)
        self.ends = [_Pool(np.int64), _Pool(np.int64)]
        self.pools = [_Pool(np.uint8), _Pool(np.uint8)]
        for ends in self.ends:
            ends.add(np.zeros(1, np.int64))

    def ids_bytes(self, ids: list[int]) -> bytes:
        if self.csv:
            return b"".join([b"%d," % i for i in ids])
        return np.array(ids, f"<u{self.width}").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        split, token = self.vocabulary.words.findall, self.vocabulary.token
        texts = [p.decode() for p in pieces]
        words = [[t] if t[0] == " " and t[1:].isalpha() else split(t) for t in texts]
        unique = list({w for ws in words for w in ws})
        known = {w: (len(ids), self.ids_bytes(ids), b"".join([token[i] for i in ids]))
                 for w, ids in zip(unique, self.vocabulary.encode_words([w.encode() for w in unique]))}
        got = [[known[w] for w in ws] for ws in words]
        self.counts.add(np.array([sum([k[0] for k in g]) for g in got], np.int64))
        for which in (0, 1):
            parts = [b"".join([k[which + 1] for k in g]) for g in got]
            self.ends[which].add(self.pools[which].size + np.cumsum([len(x) for x in parts]))
            self.pools[which].add(np.frombuffer(b"".join(parts), np.uint8))

    def _find(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.heads[at] == heads), self.rows[at], -1)

    def encode(self, buf: np.ndarray, offs: np.ndarray):
        """For the texts in ``buf``: number of ids, ids' bytes with offsets, decoded bytes with offsets."""
        if len(self.keys) > MEMO_PIECES or self.pools[0].size + self.pools[1].size > MEMO_BYTES:
            self.forget()
        starts = piece_starts(buf, offs)
        ends = np.append(starts[1:], len(buf))
        raw = np.concatenate([buf, np.zeros(8, np.uint8)])
        first = np.ndarray(len(buf) + 1, "<u8", raw, strides=(1,))[starts]
        size = ends - starts
        heads = np.where(size < 8, first & ((np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)), first)
        keys = Fingerprints(buf).of(starts, ends)
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        row = self._find(unique, heads[where])
        new = np.flatnonzero(row < 0)
        if len(new):
            body = buf.tobytes()
            self._learn([body[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            row[new] = np.arange(self.counts.size - len(new), self.counts.size)
            spot = np.searchsorted(self.keys, unique[new])
            self.keys = np.insert(self.keys, spot, unique[new])
            self.heads = np.insert(self.heads, spot, heads[where[new]])
            self.rows = np.insert(self.rows, spot, row[new])
        row = row[back]
        doc = np.searchsorted(starts, offs)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])[doc]
        counts = np.diff(total(self.counts.data[row]))
        out = [counts]
        for which in (0, 1):
            length = self.ends[which].data[row + 1] - self.ends[which].data[row]
            out += [gather(self.pools[which].data, self.ends[which].data[row], length), total(length)]
        if not (np.array_equal(length, size) and np.array_equal(out[3], buf)):
            return self._apart(buf, offs)
        if self.csv:  # the comma after each text's last id goes
            full = counts > 0
            keep = np.ones(len(out[1]), bool)
            keep[out[2][1:][full] - 1] = False
            out[1], out[2] = out[1][keep], out[2] - np.concatenate([[0], np.cumsum(full)])
        return out

    def _apart(self, buf: np.ndarray, offs: np.ndarray):
        """As encode, without the memo: one of its fingerprints stood for two pieces."""
        counts, ids, texts = [], [], []
        for a, b in zip(offs, offs[1:]):
            own = self.vocabulary._plain(buf[a:b].tobytes().decode())
            counts.append(len(own))
            ids.append(self.ids_bytes(own).rstrip(b",") if self.csv else self.ids_bytes(own))
            texts.append(b"".join([self.vocabulary.token[i] for i in own]))
        out = [np.array(counts, np.int64)]
        for parts in (ids, texts):
            out += [np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)]
        return out


class _Pool:
    """An array that grows at its end by doubling."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(0, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            wide = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            wide[:self.size] = self.data[:self.size]
            self.data = wide
        self.data[self.size:need] = more
        self.size = need


def _string_column(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    body = data.tobytes()
    try:
        body.decode()
    except UnicodeDecodeError:
        return pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(offs, offs[1:])], pa.string())
    return pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(body)])


_LOADED: dict[tuple[int, bool], Encoder] = {}


def loaded(source, csv: bool) -> Encoder:
    """The encoder of a broadcast vocabulary file, built once per Python worker."""
    key = hash(source.value), csv
    if key not in _LOADED:
        _LOADED[key] = Encoder(Vocabulary(source.value), csv)
    return _LOADED[key]


def encode_part(part: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, encoder: Encoder, column: int = 1):
    """Encoder.encode, with texts that hold a special token's string encoded one by one."""
    vocabulary = encoder.vocabulary
    body = buf.tobytes()
    odd = [k for k, t in enumerate(part.column(column).to_pylist()) if t and vocabulary.split_special.search(t)] if any(
        s.encode() in body for s in vocabulary.special) else []
    counts, ids, at, text, text_at = encoder.encode(buf, offs)
    if odd:
        pieces = [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
        backs = [text[a:b].tobytes() for a, b in zip(text_at, text_at[1:])]
        for k in odd:
            own = vocabulary.encode(part.column(column)[k].as_py())
            counts[k] = len(own)
            pieces[k] = encoder.ids_bytes(own).rstrip(b",") if encoder.csv else encoder.ids_bytes(own)
            backs[k] = vocabulary.decode(own).encode()
        ids, text = (np.frombuffer(b"".join(x), np.uint8) for x in (pieces, backs))
        at, text_at = (np.concatenate([[0], np.cumsum([len(y) for y in x])]) for x in (pieces, backs))
    return counts, ids, at, text, text_at


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                  arrays: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded). ``ids`` are decimal numbers joined by commas, or
    an array of integers with ``arrays``."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(source, True)
        for part, buf, offs in chunks(batches, "text"):
            counts, ids, at, text, text_at = encode_part(part, buf, offs, encoder)
            csv = _string_column(ids, at)
            if arrays:
                csv = pa.array([[int(x) for x in a.split(",")] if a else [] for a in csv.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), csv, _string_column(text, text_at)],
                                             ["doc_id", "n_tokens", "ids", "decoded"])

    narrow = with_text(docs, id_col, text_col)
    kind = "array<int>" if arrays else "string"
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids {kind}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_decode's rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
