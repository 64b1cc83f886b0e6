"""Near-duplicate clusters held against brute force: documents that share a line, and clusters of several blocks."""

from __future__ import annotations

import random

from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from tabloom.llm import parity_join


def components_of(sets, link):
    """The least id that each id of (id, set) pairs is connected with."""
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if link(a, b) and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_parity_join_divides_clusters_that_share_a_line_only(spark, monkeypatch):
    """Short documents with a common line are candidates of each other by its shingles alone: 500 of them, and 300 near copies of one
    text, as brute force links them. The sets dealt to the comparison grow with the documents, not with a cluster's square."""
    rng = random.Random(23)
    para = lambda n: [f"w{rng.randint(0, 10 ** 6)}" for _ in range(n)]
    line, base = para(14), para(60)
    texts = [para(rng.randint(4, 14)) + line for _ in range(500)]
    texts += [t + para(1) for t in texts[:40]]
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"v{k}"
        texts.append(line + copy if k % 3 else copy)
    texts += [line, line + para(1), para(3) + line]
    sets = [(k, frozenset(tuple(t[j:j + 5]) for j in range(len(t) - 4))) for k, t in enumerate(texts)]
    root = components_of(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    dealt, apply = [], PandasGroupedOpsMixin.applyInPandas
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda rows, *a: dealt.append(rows._df.count()) or apply(rows, *a))
    got = {r["doc_id"]: r["component_id"] for r in parity_join.near_duplicates(docs, 5, 80).collect()}
    assert got == root
    assert 300 < sum(dealt) < 1.5 * len(texts)


def test_blocks_of_a_cluster_meet(spark, monkeypatch):
    """Links across the blocks of a cluster are found, though no document connects the blocks; an id on several rows is one document."""
    rng = random.Random(29)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(40)]
    texts = []
    for k in range(90):  # each links with its neighbours in the chain only
        texts.append(base[k % 30:] + [f"c{k // 30}-{j}" for j in range(k, k + 60)])
    rows = [(k if k != 50 else 10, t) for k, t in enumerate(texts)]
    sets = [(i, frozenset(tuple(t[j:j + 2]) for j in range(len(t) - 1))) for i, t in rows]
    root = components_of(sets, lambda a, b: 100 * len(a & b) >= 70 * len(a | b))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(parity_join, "MIN_BLOCK", 4)
    monkeypatch.setattr(parity_join, "HUBS", 0)
    got = {r["doc_id"]: r["component_id"] for r in parity_join.near_duplicates(docs, 2, 70).collect()}
    assert got == root
    assert 1 < len(set(root.values())) < len(root)
