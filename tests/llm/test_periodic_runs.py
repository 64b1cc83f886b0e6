"""Periodic runs against plain comparison of all shifts: texts of few words, tiles of all sizes, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tabloom.llm import periodic_runs, queries

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [[]]
    for ch in text or "":
        out.append([]) if ch in WHITE else out[-1].append(ch)
    return ["".join(w) for w in out if w]


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w, least):
    """Runs (start, period, length) of a list of words."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and smallest_period(w[i:j + q]) == q:
                out.append((i, q, j - i + q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def texts():
    rng = random.Random(12)
    some = lambda k, n: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    out = [some(k, n) for k in (1, 2, 3, 8) for n in (0, 1, 2, 11, 12, 13, 40, 150)]
    for p, e in ((1, 30), (2, 9), (3, 4.5), (7, 2), (7, 1.9), (16, 3.2), (33, 2.5), (64, 4)):
        unit = [f"u{rng.randint(0, 40)}" for _ in range(p)]
        out.append(some(8, 9) + " " + " ".join(unit[i % p] for i in range(int(p * e))) + "\n\t" + some(3, 12))
    unit = (some(2, 6) + " x ") * 4 + some(2, 5) + " "
    out += [unit * 5, unit * 3 + "y " + unit * 2, "aa " * 300 + "b " + "aa " * 300, "é😀  x " * 20, "one", " \t ", "", None]
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), " ".join("ab"[bin(i).count("1") % 2] for i in range(512))]


@pytest.mark.parametrize("tile_words,least", [(8192, 12), (32, 12), (8, 3), (64, 2)])
def test_runs_equal_brute_force(spark, tile_words, least):
    rows = [(i if i % 9 else None, t, "x", 1, "clash") for i, t in enumerate(texts())]
    rows += [rows[5], rows[-1]]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, key int, period string").repartition(3)
    want = []
    for r in rows:
        w = words_of(r[1])
        runs = brute(w, least)
        want.append((r[0], len(w), [(s, n, q) for s, q, n in runs], " ".join(collapsed(w, runs))))
    got = periodic_runs.find_runs(docs, least, tile_words).collect()
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_documents_are_stitched_from_tiles(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 5000)}"
    unit, small = [word() for _ in range(900)], [word() for _ in range(5)]
    w = [word() for _ in range(500)] + unit * 3 + unit[:77] + [word() for _ in range(40)] + small * 200 + [word() for _ in range(300)] + ["z"] * 1000
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[::-1]))], "doc_id long, text string")
    want = {1: (500, 2777, 900), 2: (len(w) - 500 - 2777, 2777, 900)}
    one, tiled = (sorted(map(tuple, periodic_runs.find_runs(docs, 12, n, digest=True).collect())) for n in (8192, 256))
    assert one == tiled
    for doc, n, runs, _ in tiled:
        runs = [tuple(r) for r in runs]
        assert n == len(w) and want[doc] in runs and any(q == 5 and size >= 1000 for _, size, q in runs) and any(q == 1 and size == 1000 for _, size, q in runs)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "g"] + [f"v{k}" for k in range(60)]) for _ in range(rng.choice([0, 1, 5, 30, 120, 300])))) for i in range(90)]
    rows += [(170, None), (None, "a " * 20), (171, "  q  \t")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc, text in rows:
        w = words_of(text)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        runs = brute(w, 12)
        best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
        r = got[doc]
        assert r["n_runs"] == len(runs)
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(w, runs)).encode()).hexdigest()
    assert planted >= 3 and len(got) == len(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.find_runs(empty).collect() == []


def test_block_numbers_are_exact():
    ids = np.array([1, 2, 1, 2, 1, 2, 3], np.int64)
    laid = np.concatenate([[-1], ids, [-1], ids[:4], [-1]])
    text = np.array([0] * 9 + [1] * 5)
    b = periodic_runs._Blocks(laid, text, 7)
    assert b.equal(1, np.array([1, 1, 1, 6]), np.array([3, 2, 9, 5])).tolist() == [True, False, False, False]
    assert b.agree(np.array([1]), np.array([2]), 3, 1).tolist() == [4] and b.agree(np.array([5]), np.array([2]), 3, -1).tolist() == [4 - 0]
