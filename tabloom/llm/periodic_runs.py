"""Periodic runs of words: maximal stretches that repeat with a smallest period, found on tiles per scale.

A run of period q is a maximal stretch whose words q apart are identical, at least ``min_length`` and 2 q words
long, q being its smallest period. Periods are worked on by octave, P <= q < 2 P. A run of such a period
matches itself shifted by q over at least P words, so among boundaries set every H <= P / 2 words one has a whole
block of H words inside that match. For every boundary c of a tile, the shifts q at which its block recurs are
looked up; the values of the boundary's two Z-functions at these shifts (how far the text from c on agrees
with the text from c + q on, and how far it does to the left) give the run, cut off W >= 2 P words away from c. A shift
whose q words from c on are themselves a power of a shorter word is dropped: the run there has a smaller period.

A document of at most ``tile_words`` words is one tile for all its octaves, solved where it is read. A longer one
is exploded into overlapping tiles, rows of their own: tiles of ``tile_words`` words for the octaves up to an
eighth of that, then 16 times longer ones for the next four octaves, and so on; each owns a range of boundaries and
holds enough words around it. They are dealt over the cluster and solved independently. Fragments of
runs are then shuffled by document and period, and those that touch are stitched to whole runs.

Words are numbered exactly (by their bytes), and blocks of 2, 4, 8, ... words by pairs of their halves' numbers, so
equality is never decided by a hash.

Words are the maximal stretches without the bytes 0x20 and 0x09-0x0D, unchanged. Null and empty texts have no word
and no run. Rows keep their multiplicity: equal ids and equal rows are documents of their own. Null ids stay. Extra
columns are ignored. Of two runs with one start the shorter period comes first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import array_bytes, chunks, keep, ship, with_text, word_spans

TILE_WORDS = 8192
BAND_OCTAVES = 4          # octaves of each further size of tile
CANDIDATES = 1 << 21      # (boundary, shift) pairs looked up at a time
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_FRAGMENT = pa.struct([("period", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def find_runs(docs: DataFrame, min_length: int = 12, tile_words: int = TILE_WORDS, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed): ``runs`` is an array of (start, length, period) in this order of start and
    period, ``collapsed`` the words, joined by one space, that no run holds after its first period. With
    ``digest`` it is the SHA-256 of that text instead, so that texts without a run need not be carried on."""
    spark = docs.sparkSession
    ship(spark)
    narrow = with_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    found = keep(narrow.mapInArrow(_scan(min_length, tile_words, digest), (
        f"key bigint, doc_id {kind}, n_words bigint, collapsed string, words binary, fragments array<struct<period: bigint, lo: bigint, hi: bigint>>, "
        "band int, first bigint, own bigint, stop bigint, ids binary")))
    tiles = found.where("band is not null").select("key", "band", "first", "own", "stop", "ids").repartition("key", "band", "first")
    fragments = found.where("band is null").select("key", F.explode("fragments").alias("f")).select("key", "f.period", "f.lo", "f.hi").unionByName(
        tiles.mapInArrow(_solve_tiles(min_length, tile_words), "key bigint, period bigint, lo bigint, hi bigint"))
    runs = _stitched(fragments, min_length).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("r")).select(
        "key", F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    documents = found.where("band is null").select("key", "doc_id", "n_words", "collapsed", "words")
    plain = documents.where("words is null").select("doc_id", "n_words", F.expr(f"cast(array() as array<{_RUN}>)").alias("runs"), "collapsed")
    with_runs = documents.where("words is not null").select("key", "doc_id", "n_words", "words").join(runs, "key", "left").select("doc_id", "n_words", "words", "runs")
    return plain.unionByName(with_runs.mapInArrow(_collapse(digest), f"doc_id {kind}, n_words bigint, runs array<{_RUN}>, collapsed string"))


def _stitched(fragments: DataFrame, min_length: int) -> DataFrame:
    """Runs (key, start, length, period): touching fragments of one document and period are one match of the text with
    itself, [lo, hi) shifted by the period."""
    line = Window.partitionBy("key", "period").orderBy("lo", "hi")
    before = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("fresh", F.when(F.col("lo") <= before, 0).otherwise(1)).withColumn("part", F.sum("fresh").over(line))
    whole = parts.groupBy("key", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return whole.select("key", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(min_length), 2 * F.col("period")))


class _Blocks:
    """Exact numbers of the blocks of 1, 2, 4, ... words of several texts laid out in one array, -1 before, between and
    after them. From two words on a number is only given to blocks that recur in their text; the others have -1."""

    def __init__(self, words: np.ndarray, text: np.ndarray, longest: int):
        self.names = [words.astype(np.int32)]
        size = 1
        while 2 * size <= longest:
            last = self.names[-1]
            new = np.full(len(last), -1, np.int32)
            at = np.flatnonzero((last[:-size] >= 0) & (last[size:] >= 0))
            if not len(at):
                break
            pair = last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + size]
            if size == 1:
                pair += text[at] * (int(pair.max()) + 1)
            order = np.argsort(pair)
            pair = pair[order]
            same = pair[1:] == pair[:-1]
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            number = np.cumsum(np.concatenate([[False], ~same])) if len(pair) else pair
            new[at[order[again]]] = number[again]
            self.names.append(new)
            size *= 2

    def equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks of 2**level words at a and b lie in the texts and are equal."""
        if level >= len(self.names):
            return np.zeros(len(a), bool)
        name = self.names[level]
        x = name[np.clip(a, 0, len(name) - 1)]
        return (x >= 0) & (x == name[np.clip(b, 0, len(name) - 1)])

    def agree(self, a: np.ndarray, q: np.ndarray, limit: int, step: int) -> np.ndarray:
        """Words, at most 2**limit, over which the text at a agrees with the text at a + q, to the right (step 1) or left (-1)."""
        out = np.zeros(len(a), np.int64)
        for level in range(limit, -1, -1):
            open_ = np.flatnonzero(out < 1 << limit)
            at = a[open_] + step * out[open_] - (0 if step > 0 else 1 << level)
            out[open_] += self.equal(level, at, at + q[open_]).astype(np.int64) << level
        return out

    def is_power(self, c: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the q words at c are a power of a shorter word: for a prime r they agree with themselves q / r further on."""
        out = np.zeros(len(c), bool)
        rest = q.copy()
        while (todo := np.flatnonzero((rest > 1) & ~out)).size:
            r = _least_prime(rest[todo])
            d = q[todo] // r
            size = q[todo] - d
            level = np.frexp(size.astype(np.float64))[1] - 1
            for k in np.unique(level):
                mine = np.flatnonzero(level == k)
                a, b = c[todo[mine]], c[todo[mine]] + size[mine] - (1 << int(k))
                out[todo[mine]] |= self.equal(int(k), a, a + d[mine]) & self.equal(int(k), b, b + d[mine])
            rest[todo] //= r
            while (more := todo[rest[todo] % r == 0]).size:
                r = r[rest[todo] % r == 0]
                rest[more] //= r
                todo = more
        return out


_PRIME = np.array([0, 1], np.int64)


def _least_prime(x: np.ndarray) -> np.ndarray:
    """Least prime factors, from a sieve that grows with the largest number asked for."""
    global _PRIME
    top = int(x.max())
    if top >= len(_PRIME):
        n = max(2 * len(_PRIME), top + 1)
        least = np.arange(n, dtype=np.int64)
        for p in range(2, int(n ** 0.5) + 1):
            if least[p] == p:
                part = least[p * p::p]
                part[part == np.arange(p * p, n, p)] = p
        _PRIME = least
    return _PRIME[x]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1 of all i in a row."""
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(int(counts.sum()))


def _fragments(ids: np.ndarray, sizes: np.ndarray, own: np.ndarray, octaves: tuple[int, int], min_length: int):
    """Fragments (tile, period, lo, hi) of the runs of tiles: ``ids`` are the word numbers of all tiles in a row, ``sizes``
    their numbers of words, ``own`` their first and last-but-one own boundary word, ``octaves`` the first octave and the one after the last."""
    count = len(sizes)
    base = np.cumsum(sizes) - sizes + np.arange(count) + 1
    laid = np.full(len(ids) + count + 1, -1, np.int64)
    place = _ranges(base, sizes)
    laid[place] = ids
    text = np.zeros(len(laid), np.int64)
    text[place] = np.repeat(np.arange(count), sizes)
    longest = int(sizes.max(initial=0))
    blocks = _Blocks(laid, text, longest)
    found = []
    for octave in range(*octaves):
        p = 1 << octave
        mine = np.flatnonzero(sizes >= max(2 * p, min_length))
        if not len(mine):
            break
        shortest = min(max(p, -(-min_length // 2)), 2 * p - 1)  # the period whose runs match themselves over the fewest words
        least = max(min_length, 2 * shortest) - shortest
        level = max(0, ((least + 1) // 2).bit_length() - 1)
        if level >= len(blocks.names):
            continue
        step, reach = 1 << level, max(2 * p, min_length) - 1
        limit = reach.bit_length()
        many = np.maximum(0, -(-(own[mine, 1] - own[mine, 0]) // step))
        tile = np.repeat(mine, many)
        c = base[tile] + own[tile, 0] + step * (np.arange(len(tile)) - np.repeat(np.cumsum(many) - many, many))
        name = blocks.names[level]
        c, tile = c[name[c] >= 0], tile[name[c] >= 0]
        shifts = np.arange(p, 2 * p)
        rows = max(1, CANDIDATES // p)
        for k in range(0, len(c), rows):
            at = c[k:k + rows]
            there = name[np.minimum(at[:, None] + shifts, len(name) - 1)] == name[at][:, None]
            i, j = np.nonzero(there)
            a, q, t = at[i], shifts[j], tile[k:k + rows][i]
            inside = a + q < base[t] + sizes[t]
            a, q, t = a[inside], q[inside], t[inside]
            if not len(a):
                continue
            prime = ~blocks.is_power(a, q)
            a, q, t = a[prime], q[prime], t[prime]
            right, left = blocks.agree(a, q, limit, 1), blocks.agree(a, q, limit, -1)
            cut = 1 << limit
            run = (right == cut) | (left == cut) | ((left + right >= q) & (left + right + q >= min_length))
            found.append(np.stack([t, q, a - left - base[t], a + right - base[t]])[:, run])
    if not found:
        return np.zeros((4, 0), np.int64)
    t, q, lo, hi = np.concatenate(found, axis=1)
    order = np.lexsort((hi, lo, q, t))
    t, q, lo, hi = t[order], q[order], lo[order], hi[order]
    if not len(t):
        return np.zeros((4, 0), np.int64)
    # touching fragments of one tile and period are one
    change = (t[1:] != t[:-1]) | (q[1:] != q[:-1])
    lift = np.cumsum(np.concatenate([[0], change])) * (int(hi.max()) + 1)  # the running maximum starts anew with each tile and period
    before = np.maximum.accumulate(hi + lift)[:-1] - lift[:-1]
    first = np.flatnonzero(np.concatenate([[True], change | (lo[1:] > before)]))
    return np.stack([t[first], q[first], lo[first], np.maximum.reduceat(hi, first)])


def _octaves(n: int) -> int:
    """Octaves of the periods that a text of n words can have."""
    return max(0, (n // 2).bit_length())


def _band(band: int, tile_words: int) -> tuple[int, int, int]:
    """Octaves (first, after the last) and stride of a long document's tiles of one size."""
    base = max(1, (tile_words // 8).bit_length())
    if band == 0:
        return 0, base, tile_words
    return base + (band - 1) * BAND_OCTAVES, base + band * BAND_OCTAVES, tile_words << (BAND_OCTAVES * band)


def _cut_tiles(n: int, tile_words: int, min_length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Tiles (band, first word, stop word, own first, own stop) of a document of n words."""
    band = 0
    while (octaves := _band(band, tile_words))[0] < _octaves(n):
        low, high, stride = octaves
        halo = 8 << max(high - 1, min_length.bit_length())
        for own in range(0, n, stride):
            first = max(0, own - halo)
            yield band, first, min(n, own + stride + halo), own, min(n, own + stride)
        band += 1


def _scan(min_length: int, tile_words: int, digest: bool):
    """Arrow rows of documents to rows of documents and, of long ones, of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for part, buf, offs in chunks(batches, "text"):
            starts, ends, first = word_spans(buf, offs)
            sizes, lengths = np.diff(first), ends - starts
            ids = _word_numbers(buf, starts, lengths)
            short = sizes <= tile_words
            inside = np.repeat(short, sizes)
            own = np.stack([np.zeros(int(short.sum()), np.int64), sizes[short]], axis=1)
            t, q, lo, hi = _fragments(ids[inside], sizes[short], own, (0, 64), min_length)
            owner = np.flatnonzero(short)[t]
            joined, ends_at = _joined(buf, starts, lengths, first)
            held = ~short
            held[owner] = True
            rows = part.num_rows
            counts = np.bincount(owner, minlength=rows)
            order = np.argsort(owner, kind="stable")
            fragments = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(x[order]) for x in (q, lo, hi)], fields=list(_FRAGMENT)))
            texts = [joined[ends_at[i]:ends_at[i + 1]].tobytes() for i in range(rows)]
            keys = key + np.arange(rows)
            collapsed = [None if h else (hashlib.sha256(x).hexdigest() if digest else x.decode()) for x, h in zip(texts, held)]
            words = [x if h else None for x, h in zip(texts, held)]
            none = [pa.nulls(rows, k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield _rows(pa.array(keys), part.column(0), pa.array(sizes), pa.array(collapsed, pa.string()), pa.array(words, pa.binary()), fragments, *none)
            for i in np.flatnonzero(~short):
                mine = ids[first[i]:first[i + 1]].astype("<i4")
                for band, a, b, low, high in _cut_tiles(len(mine), tile_words, min_length):
                    kinds = part.column(0).type, pa.int64(), pa.string(), pa.binary(), pa.list_(_FRAGMENT)
                    yield _rows(pa.array([key + int(i)]), *[pa.nulls(1, k) for k in kinds], pa.array([band], pa.int32()),
                                *[pa.array([x], pa.int64()) for x in (a, low, high)], pa.array([mine[a:b].tobytes()], pa.binary()))
            key += rows

    return run


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["key", "doc_id", "n_words", "collapsed", "words", "fragments", "band", "first", "own", "stop", "ids"])


def _word_numbers(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    data = buf[_ranges(starts, lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's words joined by one space, in a row, and where the documents begin and end."""
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    wide = lengths + ~last
    ends = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(int(ends[-1]), 32, np.uint8)
    out[_ranges(ends[:-1], lengths)] = buf[_ranges(starts, lengths)]
    return out, ends[first]


def _solve_tiles(min_length: int, tile_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a tile each
                key, band, first, own, stop = (batch.column(k)[row].as_py() for k in range(5))
                ids = np.frombuffer(batch.column(5)[row].as_py(), "<i4").astype(np.int64)
                low, high, _ = _band(band, tile_words)
                _, q, lo, hi = _fragments(ids, np.array([len(ids)]), np.array([[own - first, stop - first]]), (low, high), min_length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key)), pa.array(q), pa.array(lo + first), pa.array(hi + first)], ["key", "period", "lo", "hi"])

    return run


def _collapse(digest: bool):
    """Drops what a run holds after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            buf, offs = array_bytes(batch.column(2))
            runs = batch.column(3)
            flat, at = runs.flatten(), np.concatenate([[0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy())])
            start, length, period = (flat.field(k).to_numpy() for k in range(3))
            for i in range(batch.num_rows):
                text = buf[offs[i]:offs[i + 1]]
                mine = slice(at[i], at[i + 1])
                if at[i] < at[i + 1]:
                    gaps = np.flatnonzero(text == 32)
                    n = len(gaps) + 1
                    level = np.zeros(n + 1, np.int64)
                    np.add.at(level, start[mine] + period[mine], 1)
                    np.add.at(level, start[mine] + length[mine], -1)
                    stay = np.cumsum(level[:-1]) == 0
                    begin, end = np.concatenate([[0], gaps + 1])[stay], np.concatenate([gaps, [len(text)]])[stay]
                    text, _ = _joined(text, begin, end - begin, np.array([0, len(begin)]))
                out.append(hashlib.sha256(text).hexdigest() if digest else text.tobytes().decode())
            kept = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run
