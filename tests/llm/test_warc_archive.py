"""The archives against the pages that went in: digests, revisits, rolling, and the same bytes however Spark deals the rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from tabloom.llm import queries, warc_archive

SCHEMA = "page_id long, url string, html string, shard int, digest string, `odd.name` int"


def pages():
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>page {i % 7} " + "text é " * (i % 5) * 30) for i in range(90)]
    rows += [(100, None, ""), (101, "http://a b/\n\x00é", None), (102, "", ""), (None, "http://n.org", "<p>page 1 text"), (None, None, "only here"),
             (103, "u", "long " * 40000), (104, "u", "WARC/1.1\r\n\r\n"), rows[4], rows[4], (rows[5][0], "http://z.org", rows[5][2]), (rows[6][0], "y", "one id, another page")]
    return [r + (1, "clash", 2) for r in rows]


def expected(rows, least=0):
    """Per row: (id, bytes, digest, type, refers)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] is None, rows[k][1] or ""))
    first, out = {}, []
    for k in order:
        page, _, html = rows[k][:3]
        data = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = len(data) >= least and data in first
        out.append((page, len(data), sha, "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=repr)


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


@pytest.mark.parametrize("least", [0, 10])
def test_read_back(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = warc_archive.write_archive(df.repartition(4), f"{tmp_path}/a", file_bytes=1500, range_bytes=4000, min_revisit_bytes=least).collect()
    got = warc_archive.read_archive(spark, f"{tmp_path}/a", payloads=True).collect()
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keys) for r in got), key=repr) == expected(rows, least)
    texts = {(r[2] or "").encode() for r in rows}
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == texts
    assert len({r["record_id"] for r in got}) == len(rows)
    here = files(f"{tmp_path}/a")
    assert len(here) == len(manifest) > 3 and {r["shard"] for r in manifest} != {0}
    for r in manifest:
        data = here[r["file"]]
        assert r["bytes"] == len(data) and r["sha256"] == hashlib.sha256(data).hexdigest()
        assert r["bytes"] <= 1500 or r["records"] == 1
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: re") == r["records"]
    assert sum(r["records"] for r in manifest) == len(rows) and not list(Path(f"{tmp_path}/a/_temporary").iterdir())


def test_same_bytes_however_the_rows_are_dealt(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    for name, frame in (("a", df.repartition(5)), ("b", df.coalesce(1).orderBy("html"))):
        warc_archive.write_archive(frame, f"{tmp_path}/{name}", file_bytes=3000, range_bytes=9000)
    assert files(f"{tmp_path}/a") == files(f"{tmp_path}/b") != {}


def test_refusal_of_damage_and_unlisted_files(spark, tmp_path):
    df = spark.createDataFrame(pages()[:20], SCHEMA)
    name = warc_archive.write_archive(df, f"{tmp_path}/a").first()["file"]
    path = Path(f"{tmp_path}/a/{name}")
    Path(f"{tmp_path}/a/pages-99999-00000.warc.gz").write_bytes(b"left by a dead job")
    assert warc_archive.read_archive(spark, f"{tmp_path}/a").count() == 20
    damaged = gzip.decompress(path.read_bytes()).replace(b"page 1", b"page 9", 1)
    members = [m for m in damaged.split(b"WARC/1.1\r\n") if m]
    path.write_bytes(b"".join(gzip.compress(b"WARC/1.1\r\n" + m) for m in members))
    with pytest.raises(Exception, match="damaged record"):
        warc_archive.read_archive(spark, f"{tmp_path}/a").collect()


def test_empty_table_and_text_ids(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc_archive.write_archive(empty, f"{tmp_path}/e").collect() == []
    assert warc_archive.read_archive(spark, f"{tmp_path}/e").collect() == []
    df = spark.createDataFrame([("b\r\nX: 1", "u", "x"), ("a %20é", "v", "x")], "page_id string, url string, html string")
    warc_archive.write_archive(df, f"{tmp_path}/t")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_archive.read_archive(spark, f"{tmp_path}/t", "string").collect()}
    assert got == {"a %20é": ("response", None), "b\r\nX: 1": ("revisit", "a %20é")}


def test_query_equals_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(queries.SQL["op13_warc"]).df()
    got = queries.op13_warc(spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, got[cols].astype(object).where(got.notna(), None).itertuples(index=False, name=None))) == sorted(map(repr, want[cols].astype(object).where(want.notna(), None).itertuples(index=False, name=None)))
