"""Hard negatives against plain sorting of all scores: ties, repeated rows and ids, odd vectors, small parts and blocks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import hard_negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>, key int, score string, `odd.name` int"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=5):
    good = [(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, lab, v) in enumerate(good):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, lb == lab) for j, (b, lb, w) in enumerate(good) if j != k and len(w) == len(v))
        for ps, p in [(-s, b) for s, b, same in scored if same][:positives]:
            hard = [(-s, b) for s, b, same in scored if not same and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, r + 1, b, ps, s) for r, (s, b) in enumerate(hard)]
    return sorted(out)


def rows(n=400, d=6, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, d))
    out = []
    for i in range(n):
        lab = int(rng.integers(0, 5))
        v = (centers[(lab + (i % 9 == 0)) % 5] + rng.normal(size=d) * 0.4) * rng.choice([0.05, 0.3, 1])
        out.append((i, lab, [float(np.float32(x)) for x in v]))
    out += [(i + 1000, i % 3, [0.01 * (i % 2), 0.0, -0.01, 0.0, 0.5, 0.0]) for i in range(40)]  # ties
    out += [(2000, 1, [0.0] * d), (2005, 1, [0.0] * d), (2010, None, [1.0] * d), (2015, 1, None), (2020, 1, [1.0] * (d - 1) + [None]), (2025, 1, [1.0] * (d - 1) + [math.nan]),
            (2030, 1, [math.inf] * d), (None, 1, [1.0] * d), (2035, 0, [0.5, 0.25]), (2036, 0, [0.5, 0.5]), (2037, 1, [0.25, 0.25]), (2040, 2, []), (2041, 2, []), (2042, 1, [])]
    return out + [out[5], out[5], out[10], (15, 3, out[16][2]), (15, 4, out[16][2])]


def got(spark, data, **more):
    df = spark.createDataFrame([r + (1, "x", 2) for r in data], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 5 == 0, **more).collect())


@pytest.mark.parametrize("list_rows,members", [(8192, 256), (48, 20)])
def test_equals_brute_force(spark, monkeypatch, list_rows, members):
    for name, value in (("LIST_ROWS", list_rows), ("MEMBERS", members), ("BLOCK", members), ("STEP", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    data = rows()
    want = brute(data)
    assert len(want) > 300 and got(spark, data) == want


def test_other_depths_and_shares(spark):
    data = rows(120, 3, 2)
    data = [r for r in data if r[2] is None or len(r[2]) == 3]
    assert got(spark, data, positives=2, negatives=7, low=-100, high=120) == brute(data, 2, 7, -100, 120)


def test_no_anchor_and_empty_table(spark):
    assert got(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == [] == got(spark, [])


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, u = rng.integers(-99, 99, (300, 5)).astype(float), rng.integers(-99, 99, (40, 5)).astype(float)
    c = hard_negatives._spherical_means(u / np.sqrt((u * u).sum(1, keepdims=True)), 3)
    angle = hard_negatives._angles(u, c)
    home = angle.argmin(1)
    for k in range(3):
        mine = home == k
        wide = angle[mine, k].max()
        bound = np.sqrt((x * x).sum(1)) * np.cos(np.maximum(0, hard_negatives._angles(x, c)[:, k] - wide))
        assert (u[mine] @ x.T <= np.sqrt((u[mine] ** 2).sum(1))[:, None] * bound + 1e-6).all()


def test_query_equals_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.SQL["op11_hard_negatives"])
    out = queries.op11_hard_negatives(spark, sf)
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())
