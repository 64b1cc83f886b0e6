"""WARC archives of a table of pages: a deterministic sharded writer, and the reader.

Records are range-sorted by (id, url, payload). The ranges are cut at records whose hash falls on a multiple of
a number that depends on the table's size only (at most about ``MAX_RANGES`` of them), so they
do not depend on how Spark dealt the rows. Each record is made and compressed, a gzip member of its own,
where its page is read, and only then shuffled. The task that gets a range writes its members in order and starts a
new file when the next one would take it beyond ``file_bytes``. A file is written under a name of its
attempt and renamed when it is complete; the same rows give the same bytes, so a second attempt or a lost
executor leaves the same file. The table ``manifest`` beside the files (name, records, bytes, SHA-256) is committed by the
job that writes them, last: a reader takes the files that it names and nothing else.

Of pages with equal payloads of at least ``min_revisit_bytes`` bytes the first in the order (id, url) is written as
``response``, the others as ``revisit`` records of it, with headers only. Which pages have a fellow is found on a narrow table of SHA-256 digests;
a revisit learns of it by a row of its key that sorts before it. Headers, lengths, block and payload digests (base32
SHA-1) are made anew for each record; the table has no capture time, so ``date`` stands for it.

Null payloads are empty payloads. Null ids and urls sort last; a null id is not written (its record has no id header), a null url
stands as ``about:blank``. Equal rows are records of their own: one response, the others
revisit it. Extra columns are ignored. An empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import checkpoint_dir, drop, keep, ship

MAX_RANGES = 1 << 14
RECORD_BYTES = 512  # headers of a record, for the sizes of ranges
READ_BYTES = 1 << 20
READ_TASKS = 1 << 13
_URL_SAFE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def write_archive(pages: DataFrame, path: str, file_bytes: int = 256 << 20, range_bytes: int = 16 << 20, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                  level: int = 6, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages below ``path`` (a folder that all workers share); the manifest's rows
    (file, shard, records, revisits, bytes, sha256)."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")
    narrow = keep(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")))
    count, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = (size + RECORD_BYTES * count) / max(1, count)
    every = max(1, round(max(range_bytes, (size + RECORD_BYTES * count) / MAX_RANGES) / max(1.0, mean)))
    chosen = narrow.where(F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(every)) == 0).select("page_id", "url", "digest").distinct().collect()  # about MAX_RANGES at most
    cuts = spark.sparkContext.broadcast(sorted(_order(r["page_id"], r["url"], bytes(r["digest"])) for r in chosen))
    fellows = narrow.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min(F.struct(F.isnull("page_id").alias("a"), "page_id", F.isnull("url").alias("b"), "url")).alias("first"),
                                                                              F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = narrow.select("page_id", "url", "digest").distinct().join(fellows.select("digest", "first"), "digest").select(
        "page_id", "url", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    made = rows.mapInArrow(_members(cuts, date, level), f"shard int, page_id {kind}, url string, digest binary, copies bigint, member binary, size bigint, sha1 string")
    told = marks.mapInArrow(_placed(cuts), f"shard int, page_id {kind}, url string, digest binary, first_id {kind}, first_url string")
    dealt = made.unionByName(told, allowMissingColumns=True).repartitionById(len(chosen) + 1, F.col("shard")).sortWithinPartitions(
        F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "digest", F.col("member").isNotNull())
    place = path.rstrip("/")
    system, folder = _location(place)
    system.create_dir(f"{folder}/_temporary", recursive=True)
    dealt.mapInArrow(_writer(place, file_bytes, date, level), "file string, shard int, records bigint, revisits bigint, bytes bigint, sha256 string").write.parquet(f"{place}/manifest")
    drop(narrow)
    return spark.read.parquet(f"{place}/manifest")


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """Rows (page_id, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest) of all records of the
    archive's files, with ``payloads`` also (payload). Lengths and digests are checked against the
    content; a revisit's are those of the response that it stands for, and its payload is null."""
    ship(spark)
    place = path.rstrip("/")
    files = spark.read.parquet(f"{place}/manifest").select("file")
    tasks = max(1, min(files.count(), READ_TASKS))
    found = files.repartition(tasks).mapInArrow(_reader(place, payloads), "page_id string, record_type string, record_id string, target_uri string, refers_to string, "
                                                 "payload_bytes bigint, payload_digest string" + (", payload binary" if payloads else ""))
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"


def _location(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _order(page_id, url: str | None, digest: bytes) -> tuple:
    """Sorts as the shards do: nulls last."""
    return (page_id is None, page_id if page_id is not None else 0, url is None, url or "", digest)


def _record_id(page_id, url: str | None, digest: bytes, copy: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id is None}:{page_id}:{url is None}:{url}:{digest.hex()}:{copy}"))


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as one gzip member, without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"WARC-Block-Digest: sha1:{_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _headers(kind: str, page_id, url: str | None, digest: bytes, copy: int, sha1: str, date: str) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{_record_id(page_id, url, digest, copy)}>"), ("WARC-Date", date),
           ("WARC-Target-URI", _uri(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    return out + ([("X-Page-Id", quote(str(page_id), safe=""))] if page_id is not None else [])


def _uri(url: str | None) -> str:
    return quote(url, safe=_URL_SAFE) if url else "about:blank"


def _revisit(row: dict, copy: int, first: tuple, date: str, level: int) -> bytes:
    first_id, first_url = first
    headers = _headers("revisit", row["page_id"], row["url"], row["digest"], copy, row["sha1"], date) + [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", f"<urn:uuid:{_record_id(first_id, first_url, row['digest'], 0)}>"),
        ("WARC-Refers-To-Target-URI", _uri(first_url)), ("WARC-Refers-To-Date", date)]
    if first_id is not None:
        headers.append(("X-Refers-To-Page-Id", quote(str(first_id), safe="")))
    return _member(headers, _http(row["size"]), level)


def _members(cuts, date: str, level: int):
    """Pages to their shard and their compressed response record; equal rows of a batch are one row with its number of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, digests = (batch.column(k).to_pylist() for k in range(3))
            rows: dict[tuple, list] = {}
            for k, key in enumerate(zip(ids, urls, digests)):
                if key in rows:
                    rows[key][4] += 1
                    continue
                page_id, url, digest = key
                payload = batch.column(3)[k].as_py()
                sha1 = _sha1(payload)
                member = _member(_headers("response", page_id, url, digest, 0, sha1, date), _http(len(payload)) + payload, level)
                rows[key] = [bisect.bisect_right(cuts.value, _order(*key)), page_id, url, digest, 1, member, len(payload), sha1]
            cols = list(zip(*rows.values())) or [()] * 8
            kinds = [pa.int32(), batch.column(0).type, pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "page_id", "url", "digest", "copies", "member", "size", "sha1"])

    return run


def _placed(cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            shard = pa.array([bisect.bisect_right(cuts.value, _order(*key)) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], ["shard", *batch.schema.names])

    return run


class _Roller:
    """The files of one shard: members are appended, a new file begins before one would outgrow ``limit``."""

    def __init__(self, system: fs.FileSystem, folder: str, shard: int, limit: int, date: str, level: int):
        self.system, self.folder, self.shard, self.limit, self.date, self.level = system, folder, shard, limit, date, level
        self.part, self.out, self.done = 0, None, []

    def add(self, member: bytes, revisit: bool) -> None:
        if self.out is not None and self.bytes + len(member) > self.limit and self.records:
            self.close()
        if self.out is None:
            self.name = f"pages-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.attempt = f"{self.folder}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sum = self.system.open_output_stream(self.attempt, compression=None), hashlib.sha256()
            self.bytes = self.records = self.revisits = 0
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>"), ("WARC-Date", self.date),
                    ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(_member(info, b"format: WARC File Format 1.1\r\n", self.level))
        self._put(member)
        self.records += 1
        self.revisits += revisit

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.system.get_file_info(final).type != fs.FileType.NotFound:
            self.system.delete_file(final)  # of an earlier attempt, with the same bytes
        self.system.move(self.attempt, final)
        self.done.append((self.name, self.shard, self.records, self.revisits, self.bytes, self.sum.hexdigest()))
        self.part, self.out = self.part + 1, None


def _writer(place: str, file_bytes: int, date: str, level: int):
    """Sorted rows of whole shards to files; a row of the manifest for each."""
    small = ["shard", "page_id", "url", "digest", "copies", "size", "sha1", "first_id", "first_url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _location(place)
        files, key, first, copy = None, None, None, 0
        for batch in batches:
            members = batch.column(batch.schema.get_field_index("member"))
            for k, row in enumerate(batch.select(small).to_pylist()):
                if files is None or files.shard != row["shard"]:
                    if files is not None:
                        files.close()
                        yield _manifest(files.done)
                    files = _Roller(system, folder, row["shard"], file_bytes, date, level)
                if (now := (row["page_id"], row["url"], row["digest"])) != key:
                    key, first, copy = now, None, 0
                member = members[k].as_py()
                if member is None:
                    first = (row["first_id"], row["first_url"])
                    continue
                for _ in range(row["copies"]):
                    revisit = first is not None and (first != now[:2] or copy > 0)
                    if revisit:
                        files.add(_revisit(row, copy, first, date, level), True)
                    elif copy:  # equal rows too short for a revisit
                        files.add(_again(member, row, copy, level), False)
                    else:
                        files.add(member, False)
                    copy += 1
        if files is not None:
            files.close()
            yield _manifest(files.done)

    return run


def _again(member: bytes, row: dict, copy: int, level: int) -> bytes:
    """The same response record under the id of another copy."""
    old, new = (_record_id(row["page_id"], row["url"], row["digest"], c).encode() for c in (0, copy))
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(zlib.decompress(member, 31).replace(old, new, 1)) + z.flush()


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "shard", "records", "revisits", "bytes", "sha256"])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a .warc.gz stream, member by member."""
    z, held = zlib.decompressobj(31), []
    while data := stream.read(READ_BYTES):
        while data:
            held.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield _parsed(b"".join(held))
                z, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("the archive ends within a record")


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    block = rest[:size]
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def _reader(place: str, payloads: bool):
    names = ["page_id", "record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * payloads

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _location(place)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_read(headers, block, payloads))
                        held += len(block) if payloads else 256
                        if held > READ_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def _read(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = headers["WARC-Type"] == "response"
    if whole and (len(payload) != size or _sha1(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not agree with its headers")
    page, refers = (unquote(headers[k]) if k in headers else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
    row = (page, headers["WARC-Type"], headers["WARC-Record-ID"][1:-1], headers["WARC-Target-URI"], refers, size, digest)
    return row + ((payload if whole else None,) if payloads else ())
