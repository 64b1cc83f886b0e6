"""Near-duplicate documents: an exact Jaccard join of word shingles by parity sketches.

A document's set is its distinct shingles of n consecutive words (A-Z lower-cased); with fewer
words the whole sequence is one shingle; without words the set is empty and linked with
nothing. Two documents link when 100 * |intersection| >= percent * |union|, which means that
their symmetric difference is at most (|A| + |B|) * (100 - percent) / (100 + percent).

Documents with the same set are one class, with its smallest id as representative. Sizes
are divided into bands; a pair lies within one band or across one border, and for each of
these families the largest possible difference d is known. Every shingle is hashed into one
of 2 (d + 1) blocks and XORed into it. A document's keys are its d + 1 fullest blocks (by number of shingles,
then by hash): a difference of at most d shingles leaves at least one of them untouched, and of two linked
documents' keys the untouched one that ranks higher is a key of both, since the order
depends on a block's content alone. So linked sets share a (family, block, XOR) key: the pigeonhole join. The
rows of a key are streamed in order, each joined with the key's first document only, so no
group is held in memory or expanded into pairs; clusters of candidates are the components
of these edges. Keys are made and streamed in ``WAVES`` waves, by the key's hash, each from the texts.

A block of few shingles that many documents hold (a common line) makes one cluster of documents that have little else in common,
and it grows faster than the table. So clusters of more than ``MIN_BLOCK`` documents are divided again: their
shingles are put in order of the number of their sets that hold them, the rarest first. Linked sets have a shingle in common
among the first n - ceil(percent * n / 100) + 1 of each (the prefix filter, exact in any order that is the same for all),
so only documents that share one of these stay candidates, and the components of their edges are the clusters.

Within a cluster documents are compared in blocks of bounded size. A pair is first tested by parity sketches of
``SKETCH_BITS`` bits, whose Hamming distance is a lower bound of the symmetric difference; what
remains is verified on the sets of shingle hashes unless it is connected already. A block
reports a spanning forest of its links only. A cluster of several blocks is compared block by block first, with about ``HUBS``
documents of it in every block, which connect the blocks' groups. Only what is left then is compared across blocks: the documents outside the
cluster's largest group with each other and with that group, whose own pairs are connected. A cluster that hangs together is thus
dealt about once, however large it is.

Null and empty texts have an empty set. Rows that share an id are one document whose links
are those of all its rows. A row with a null id is returned with a null component and links
with nothing. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import Fingerprints, binary_column, chunks, cut_lineage, drop, keep, mix64, release, ship, word_spans
from tabloom.llm.components import connected_components

SKETCH_BITS = 1024
MIN_BLOCK, MAX_BLOCK, BLOCKS, HUBS = 128, 2048, 16, 16
WAVES = 2
U = np.uint64


def borders(percent: int, most: int) -> np.ndarray:
    """Upper ends of the size bands. In the first band a link needs equal sets."""
    first = 0
    while 2 * (first + 1) * (100 - percent) // (100 + percent) == 0:
        first += 1
    out, ratio = [max(first, 1)], max(1.35, 105 / percent)
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, document after document, and where each document's begin."""
    starts, ends, doc = word_spans(buf, offs)
    words = Fingerprints(buf).of(starts, ends)
    counts = np.diff(doc)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(len(words), U)
    for k in range(n):  # words k places further on, as far as the document goes
        there = np.arange(len(words)) + k < doc[1:][owner]
        h[there] = mix64(h[there] * U(0x9E3779B97F4A7C15) + words[np.flatnonzero(there) + k])
    whole = (np.arange(len(words)) + n <= doc[1:][owner]) | (np.arange(len(words)) == doc[:-1][owner])
    h, owner = h[whole], owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(counts) + 1))


def _family_keys(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the documents' families, document after document, and the number of each one's keys."""
    size = np.diff(at)
    high = borders(percent, max(int(size.max(initial=0)), 1))
    band = np.searchsorted(high, size)  # size <= high[band]
    bound = lambda total: total * (100 - percent) // (100 + percent) + 1
    below = high[np.maximum(band - 1, 0)]
    families = [
        (2 * band, np.where((size > 0) & (band > 0), bound(2 * high[band]), 0)),
        (2 * band + 1, np.where((size > 0) & (100 * size // percent > high[band]), bound(high[band] + 100 * high[band] // percent), 0)),
        (2 * band - 1, np.where((band > 0) & (-(-percent * size // 100) <= below), bound(below + 100 * below // percent), 0)),
    ]
    per_doc = sum(m for _, m in families)
    out = np.zeros(int(per_doc.sum()), U)
    base = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    owner = np.repeat(np.arange(len(size)), size)
    for family, m in families:
        mine = np.flatnonzero(m[owner] > 0)
        own = owner[mine]
        salt = mix64((family.astype(np.int64) + 1).astype(U) * U(0xA24BAED4963EE407))
        block = mix64(h[mine] ^ salt[own])
        begin = 2 * np.concatenate([[0], np.cumsum(m)])
        spot = begin[own] + (block % (2 * m[own]).astype(U)).astype(np.int64)
        order = np.argsort(spot, kind="stable")
        first = np.flatnonzero(np.diff(spot[order], prepend=-1))
        parity, full = np.zeros(begin[-1], U), np.bincount(spot, minlength=begin[-1])
        if len(first):
            parity[spot[order][first]] = np.bitwise_xor.reduceat(h[mine][order], first)
        doc = np.repeat(np.arange(len(size)), 2 * m)
        key = mix64(parity ^ mix64(salt[doc] + (np.arange(len(parity)) - begin[doc]).astype(U)))
        order = np.lexsort((key, -full, doc))  # the fullest first
        place = np.arange(len(order)) - begin[doc]
        kept = place < m[doc]
        out[base[doc[kept]] + place[kept]] = key[order][kept]
        base = base + m
    return out, per_doc


def _described(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, h1, h2): size and two sums of each row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text", lower=True):
            h, at = shingle_sets(buf, offs, n)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix64(h ^ U(c)))]) for c in (0x1B873593, 0x85EBCA6B)]
            h1, h2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(h1), pa.array(h2)], ["doc_id", "n_shingles", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint")


def _keys(docs: DataFrame, n: int, percent: int, wave: int) -> DataFrame:
    """Rows (key, doc_id): the keys of each document's families that belong to one of ``WAVES`` waves. They are made where the texts are and
    go straight into the shuffle by key: a table of them would be larger than the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text", lower=True):
            keys, counts = _family_keys(*shingle_sets(buf, offs, n), percent)
            now = keys % U(WAVES) == U(wave)
            if now.any():
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys[now].view(np.int64)), pa.array(ids[now])], ["key", "doc_id"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint")


def _stars(keys: DataFrame) -> DataFrame:
    """Edges (a, b) from the documents of a key to its first document; keys come sorted, and only the
    last key and its first document are remembered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            run_start = np.flatnonzero(first)
            hubs = doc[run_start]
            if last is not None and key[0] == last:
                hubs[0] = hub
            own = hubs[np.cumsum(first) - 1]
            last, hub = key[-1], own[-1]
            edge = doc != own
            pairs = np.unique(np.stack([doc[edge], own[edge]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    parts = keys.repartition("key").sortWithinPartitions("key", "doc_id")
    # a document has as many first documents as keys: it keeps the least of them, and that one takes over its links to the others
    hubs = parts.mapInArrow(run, "a bigint, b bigint").groupBy("a").agg(F.collect_set("b").alias("hubs"))
    least = F.array_min("hubs")
    own = hubs.select("a", least.alias("b"))
    others = hubs.where(F.size("hubs") > 1).select(F.explode("hubs").alias("a"), least.alias("b")).where("a <> b")
    return own.unionByName(others).distinct()


def _sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = SKETCH_BITS // 64
    bit = (mix64(h ^ U(0xC2B2AE3D27D4EB4F)) % U(SKETCH_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    odd = np.bincount(owner * SKETCH_BITS + bit, minlength=(len(at) - 1) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1, bitorder="little").view(U).reshape(-1, words)


def _forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sets: of the pairs across the two sides (0 and 1),
    or of all pairs if every side is 0. Those of one component are connected already."""
    size = np.array([len(s) for s in sets])
    sketch = _sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    _, first, label = np.unique(component, return_index=True, return_inverse=True)
    root = first[label].tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in range(0, len(left), 256):
        rows = left[k:k + 256]
        distance = np.zeros((len(rows), len(right)), np.int32)
        for w in range(sketch.shape[1]):
            distance += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[right, w])
        total = size[rows][:, None] + size[right]
        near = (distance <= total * (100 - percent) // (100 + percent)) & (np.abs(size[rows][:, None] - size[right]) <= total * (100 - percent) // (100 + percent))
        roots = np.array([find(x) for x in range(len(ids))])
        near &= roots[rows][:, None] != roots[right]
        for i, j in np.argwhere(near).tolist():
            a, b = int(rows[i]), int(right[j])
            if a == b or (x := find(a)) == (y := find(b)):
                continue
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * shared >= percent * (size[a] + size[b] - shared):
                root[max(x, y)] = min(x, y)
                out.append((int(ids[a]), int(ids[b])))
    return out


def _compared(dealt: DataFrame, percent: int) -> DataFrame:
    """Forest edges (a, b) of the pairs of blocks i and j of every cluster; ``dealt``: (cluster, i, j, block, doc_id, component, members)."""
    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        values = [np.frombuffer(b, U) for b in pdf["members"]]
        side = (pdf["block"].to_numpy() != key[1]).astype(int)
        ids, component = pdf["doc_id"].to_numpy(np.int64), pdf["component"].to_numpy(np.int64)
        edges = _forest(ids, values, side, component, percent) if key[1] == key[2] or (side.any() and not side.all()) else []
        return pd.DataFrame(edges, columns=["a", "b"]).astype(np.int64)

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def _rare(full: DataFrame, percent: int) -> DataFrame:
    """Rows (key, doc_id): of each set the shingles that are among the first n - ceil(percent * n / 100) + 1 in the order of the
    number of the cluster's sets that hold them (then by hash), without those that no other set holds. A key is a shingle of a cluster.
    ``full``: (row, doc_id, cluster, members), ``row`` being a number of its own for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "members"):
            row, doc, cluster = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            counts = offs // 8
            counts = counts[1:] - counts[:-1]
            key = mix64(buf.view(U) ^ np.repeat(mix64(cluster.view(U)), counts))
            least = -(-percent * counts // 100)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(np.repeat(x, counts)) for x in (row, doc, least))], ["key", "row", "doc_id", "least"])

    shingles = full.select("row", "doc_id", "cluster", "members").mapInArrow(run, "key bigint, row bigint, doc_id bigint, least bigint")
    shared = shingles.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("sets > 1")
    row = Window.partitionBy("row")
    # those that no other set holds come before all others, so of the shared ones so many fewer are among the first
    placed = shared.withColumn("place", F.row_number().over(row.orderBy("sets", "key"))).withColumn("shared", F.count(F.lit(1)).over(row))
    return placed.where("place <= shared - least + 1").select("key", "doc_id")


def _block(number: Column | str) -> Column:
    """A document's block, of so many."""
    return F.pmod(F.xxhash64("doc_id"), number).cast("int")


def _links(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Forest edges (a, b) within the clusters; ``members``: (doc_id, cluster)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, "text", lower=True):
            h, at = shingle_sets(buf, offs, n)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], binary_column(h, np.diff(at))], ["doc_id", "cluster", "rows", "members"])

    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    # members grow with the documents, so both sides are shuffled at every size
    texts = docs.join(members.join(sizes, "cluster").hint("merge"), "doc_id").select("doc_id", "cluster", "rows", "text")
    full = keep(texts.mapInArrow(sets, "doc_id bigint, cluster bigint, rows bigint, members binary").withColumn("row", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    small, large = full.where(F.col("rows") <= MIN_BLOCK), full.where(F.col("rows") > MIN_BLOCK)
    one = F.lit(0)
    whole = small.select("cluster", one.alias("i"), one.alias("j"), one.alias("block"), "doc_id", F.col("doc_id").alias("component"), "members")
    if large.isEmpty():
        out = keep(_compared(whole, percent))
        drop(full)
        return out

    nodes = connected_components(cut_lineage(_stars(_rare(large, percent)))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    size = F.least(F.greatest(F.ceil(F.col("rows") / BLOCKS), F.lit(MIN_BLOCK)), F.lit(MAX_BLOCK))
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    parts = cut_lineage(nodes.join(sizes, "cluster").withColumn("size", size).withColumn("blocks", F.ceil(F.col("rows") / F.col("size")).cast("int")))
    hub = F.pmod(F.xxhash64("doc_id", F.lit(1)), "rows") < HUBS
    spread = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block("blocks")))).alias("i")
    large = large.select("doc_id", "members")
    own = large.join(parts, "doc_id").select("cluster", "doc_id", "members", spread)
    own = own.select("cluster", "i", F.col("i").alias("j"), F.col("i").alias("block"), "doc_id", F.col("doc_id").alias("component"), "members")
    within = keep(_compared(whole.unionByName(own), percent))
    release(docs.sparkSession)

    parts = parts.where("blocks > 1")
    groups = connected_components(within.join(parts.select(F.col("doc_id").alias("a")), "a").select("a", "b"))
    parts = parts.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = parts.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("docs"))
    most = counts.groupBy("cluster").agg(F.max(F.struct("docs", "component")).alias("most"), (F.sum("docs") - F.max("docs")).alias("others")).where("others > 0")
    parts = parts.join(most, "cluster").withColumn("other_blocks", F.ceil(F.col("others") / F.col("size")).cast("int"))
    parts = parts.withColumn("most_blocks", F.ceil(F.col("most.docs") / F.col("size")).cast("int")).withColumn("in_most", F.col("component") == F.col("most.component"))
    block = F.when(F.col("in_most"), F.col("other_blocks") + _block("most_blocks")).otherwise(_block("other_blocks"))
    against = F.when(F.col("in_most"), F.col("other_blocks")).otherwise(F.col("other_blocks") + F.col("most_blocks"))
    apart = cut_lineage(parts.select("doc_id", "cluster", "component", block.alias("block"), against.alias("against")))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("against") - 1), lambda o: F.struct(
        F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))).alias("pair")
    dealt = large.join(apart, "doc_id").select("cluster", "block", "doc_id", "component", "members", pair)
    across = keep(_compared(dealt.select("cluster", "pair.i", "pair.j", "block", "doc_id", "component", "members"), percent))
    drop(full)
    return within.unionByName(across)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(_described(docs, n))
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "h1", "h2"]
    classes = cut_lineage(sets.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    reps = keep(docs.join(classes.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "zstd")
    release(docs.sparkSession)
    stars = []
    for wave in range(WAVES):  # keys take more room than the texts, so only a part of them lies in shuffle files at a time
        stars.append(cut_lineage(_stars(_keys(reps, n, percent, wave))))
        release(docs.sparkSession)
    clusters = connected_components(functools.reduce(DataFrame.unionByName, stars))
    links = _links(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), reps, n, percent)
    drop(reps)
    component = connected_components(links)
    known = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    with_set = rows.where("n_shingles > 0 and doc_id is not null").join(known, same).select("doc_id", "n_shingles", "component_id")
    return with_set.unionByName(rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
