"""Training-order materialisation: token ids as fixed-stride binary shards in a keyed random order.

Every document becomes sequences of ``length`` ids: its ids and one end id, the last sequence
filled up with end ids. The documents' ids are made once, in a compressed table that the numbering and the writing read; it goes when the
shards are written. Sequences are numbered 0..N-1 in the order of the input's partitions and rows, and a keyed Feistel
permutation of the next even power of two, walked along its cycle until it falls below N, gives each
number its global slot: a bijection that any worker computes by itself. Shard k holds the slots
[k * S, (k + 1) * S) in order, each at the byte offset (slot mod S) * stride of its file, so a
reader finds any slot by arithmetic and resumes anywhere (``read_slots``). Rows are dealt by shard and
sorted by slot; a shard is written under a name of its attempt and renamed when it is complete, so
a lost executor or a second attempt leaves the same file. ``manifest.json`` is written when all shards are, so a
folder without it is not complete.

Ids are the UTF-8 bytes (one byte each; 0xFF, no byte of UTF-8, is the end), or with a
vocabulary the ids of byte-level BPE (two bytes each, or four if its ids need them). A vocabulary whose merges stand in
the order of their ids is encoded by the tiktoken library, with the pattern and special tokens of ``bpe``; other vocabularies,
and texts that its pattern matcher refuses (runs of a million white spaces, say), by ``bpe`` itself. The ids are the same.

Null and empty texts are one sequence of end ids. Rows keep their multiplicity, null ids stay, extra
columns are ignored. An empty table writes a manifest and no shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import bpe
from tabloom.llm.common import array_bytes, binary_column, checkpoint_dir, chunks, cut_lineage, drop, keep, mix64, release, ship

ROUNDS = 6
U = np.uint64


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..total-1."""
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    mask, shift = U((1 << half) - 1), U(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key & (1 << 64) - 1))
    out = numbers.astype(U)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> shift, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[walk] = left << shift | right
        walk = walk[out[walk] >= U(total)]
    return out.astype(np.int64)


def _location(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def materialise(docs: DataFrame, path: str, length: int = 512, shard_bytes: int = 64 << 20, key: int = 20240229, vocabulary_path: str | None = None, waves: int = 4,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and ``manifest.json`` below ``path`` (a folder that all workers share) and return
    one row per sequence, in what the shards hold: (slot, shard, byte_offset, doc_id, seq, n_ids, crc32).
    The shards are written in ``waves`` ranges,
    each with a pass over the table of ids; only one range's sequences lie in shuffle files at a time."""
    spark = docs.sparkSession
    ship(spark)
    source = _source(vocabulary_path)
    width, end = _form(source)
    stride = length * width
    per_shard = max(1, shard_bytes // stride)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    encoded = keep(_encoded(narrow, source, length), compression="zstd")
    by_part = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("many").alias("n")).collect()}  # one row per input partition
    begin, total = {}, 0
    for part in sorted(by_part):
        begin[part], total = total, total + by_part[part]
    shared = spark.sparkContext.broadcast(begin)

    def cut(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        for part, ids, at in chunks(batches, "ids"):
            many = part.column(2).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), many)
            seq = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
            number = np.array([starts[p] for p in part.column(0).to_pylist()], np.int64) + part.column(1).to_numpy(zero_copy_only=False)
            slot = slots(number[owner] + seq, total, key)
            mine = (slot >= low * per_shard) & (slot < high * per_shard)
            owner, seq, slot = owner[mine], seq[mine], slot[mine]
            begins = at[owner] + seq * stride
            size = np.minimum(stride, at[owner + 1] - begins)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), part.column(3).take(pa.array(owner)), pa.array(seq.astype(np.int32)),
                                              pa.array((size // width).astype(np.int32)), binary_column(bpe.gather(ids, begins, size), size)],
                                             ["slot", "shard", "doc_id", "seq", "n_ids", "ids"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    shards = -(-total // per_shard)
    place = path.rstrip("/")
    system, folder = _location(place)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _location(place)
        now, out, name = None, None, None

        def close():
            out.close()
            system.move(name, f"{folder}/shard-{now:06d}.bin")

        for batch in batches:
            shard = batch.column(1).to_numpy(zero_copy_only=False)
            data = _filled(batch.column(5), end, length, width)
            for a, b in _runs(shard):
                if shard[a] != now:
                    if out is not None:
                        close()
                    now, name = int(shard[a]), f"{folder}/.shard-{int(shard[a]):06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                out.write(data[a * stride:b * stride].tobytes())
            offset = (batch.column(0).to_numpy(zero_copy_only=False) % per_shard) * stride
            check = [zlib.crc32(data[k * stride:(k + 1) * stride]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offset), *batch.columns[2:5], pa.array(check, pa.int64())],
                                             ["slot", "shard", "byte_offset", "doc_id", "seq", "n_ids", "crc32"])
        if out is not None:
            close()

    edges = sorted({w * shards // waves for w in range(waves + 1)}) if shards else [0, 1]
    written = []
    for low, high in zip(edges, edges[1:]):
        rows = encoded.mapInArrow(partial(cut, low=low, high=high), f"slot bigint, shard int, doc_id {kind}, seq int, n_ids int, ids binary")
        dealt = rows.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("slot")
        written.append(cut_lineage(dealt.mapInArrow(write, f"slot bigint, shard int, byte_offset bigint, doc_id {kind}, seq int, n_ids int, crc32 bigint")))
        del rows, dealt
        release(spark)
    drop(encoded)
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "width": width, "stride": stride, "slots_per_shard": per_shard, "shards": shards, "key": key}).encode())
    return reduce(DataFrame.unionByName, written)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return zip(cuts, cuts[1:]) if len(x) else iter(())


def _filled(col: pa.Array, end: int, length: int, width: int) -> np.ndarray:
    """The sequences' ids, each filled up with end ids to ``length``, one after another as bytes."""
    ids, at = array_bytes(col)
    out = np.full(len(col) * length, end, f"<u{width}").view(np.uint8)
    out[np.repeat(np.arange(len(col)) * length * width - at[:-1], np.diff(at)) + np.arange(len(ids))] = ids
    return out


def _source(vocabulary_path: str | None) -> str | None:
    if vocabulary_path is None:
        return None
    with open(vocabulary_path, encoding="utf-8") as f:
        return f.read()


@lru_cache(1)
def _loaded(source: str) -> tuple[bpe.Vocabulary, tiktoken.Encoding | None]:
    """The vocabulary of a file's content, and tiktoken's encoder of it if its merges stand in the order of their ids."""
    vocabulary = bpe.Vocabulary(source)
    added = set(vocabulary.special.values())
    ranks = {token: i for i, token in vocabulary.token.items() if i not in added}
    ordered = max(vocabulary.byte_id) < min(vocabulary.merged, default=1 << 62) and all(a < b for a, b in zip(vocabulary.merged, vocabulary.merged[1:]))
    if not ordered or len(ranks) != len(vocabulary.merged) + 256:
        return vocabulary, None
    return vocabulary, tiktoken.Encoding("vocabulary", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)


def _form(source: str | None) -> tuple[int, int]:
    """Bytes of an id, and the end id."""
    if source is None:
        return 1, 0xFF
    vocabulary, _ = _loaded(source)
    return 2 if max(vocabulary.token) < 1 << 16 else 4, max(vocabulary.special.values())


def _text_ids(text: str, vocabulary: bpe.Vocabulary, encoding: tiktoken.Encoding | None) -> np.ndarray | list[int]:
    if encoding is not None:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern matcher has run out of stack
            pass
    return vocabulary.encode(text)


def _encoded(docs: DataFrame, source: str | None, length: int) -> DataFrame:
    """Rows (part, first, many, doc_id, ids): each text's ids and end id with its input partition, the number of its first
    sequence within that partition and its number of sequences."""
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = TaskContext.get().partitionId(), 0
        width, end = _form(shared.value)
        loaded = shared.value and _loaded(shared.value)  # once a task: a look-up compares whole files
        last = np.array([end], np.uint32)
        for part, buf, offs in chunks(batches, "text"):
            if loaded:
                own = [_text_ids(t or "", *loaded) for t in part.column(1).to_pylist()]
            else:
                own = [buf[a:b] for a, b in zip(offs, offs[1:])]
            ids = np.concatenate([y for x in own for y in (x, last)]).astype(f"<u{width}").view(np.uint8)
            size = np.array([(len(x) + 1) * width for x in own])
            many = -(-size // (length * width))
            first = number + np.cumsum(many) - many
            number += int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, now, np.int32)), pa.array(first), pa.array(many), part.column(0), binary_column(ids, size)],
                                             ["part", "first", "many", "doc_id", "ids"])

    return docs.mapInArrow(run, f"part int, first bigint, many bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def read_slots(path: str, first: int, count: int) -> np.ndarray:
    """The ids of ``count`` sequences from slot ``first`` on, read in order from the shards."""
    system, folder = _location(path.rstrip("/"))
    with system.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    out = []
    slot, stop = first, min(first + count, m["sequences"])
    while slot < stop:
        shard, at = divmod(slot, m["slots_per_shard"])
        many = min(stop - slot, m["slots_per_shard"] - at)
        with system.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
            out.append(f.read_at(many * m["stride"], at * m["stride"]))
        slot += many
    return np.frombuffer(b"".join(out), f"<u{m['width']}").reshape(-1, m["length"])


def shared_folder(spark) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/training_order/{uuid.uuid4().hex}"
