"""WARC records in ZIP packages: written stored, found through the central directory, read by byte range.

A package holds two stored members, ``archive/data.warc.gz`` (a gzip member a record) and ``indexes/index.cdxj`` (one line a record: key, JSON with offset and
length inside the first member).  A reader takes the tail of the file, the end record (or the ZIP64 one), the central directory, one
local header a member, the index, and then ranges of the data member; nothing is extracted and no package is read whole.

Pages with equal payloads of at least ``MIN_SHARED`` bytes are stored once: the page with the largest ``page_id`` is the response
and the others revisit it.

Cases: a null html is an empty payload; a null url is written as the page's own name; line breaks and blanks in a url are
percent-encoded; a page without ``page_id`` is always a response of its own and comes back with a null id; rows that repeat the
largest ``page_id`` of a group are all responses; a payload above ``PACKAGE_BYTES`` gets a package to itself; an empty table writes
nothing and reads as nothing; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import read, small_batches, thrifty, write_scratch
from mailweave.session import scratch_path

MIN_SHARED = 1000
PACKAGE_BYTES = 8 << 20
RANGE_BYTES = 4 << 20  # neighbouring records are fetched together up to this size
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LIMIT16, LIMIT32 = 0xFFFF, 0xFFFFFFFF
SAFE_IN_URL = "!#$%&'()*+,/:;=?@[]~"


# ---- WARC records

def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with headers only."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "none" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = quote(url, safe=SAFE_IN_URL) if url else f"urn:page:{name}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Target-URI", target), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        fields[1:1] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's length and digest are those of the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    row = {"page_id": None if name == "none" else int(name), "url": fields["warc-target-uri"], "record_type": fields["warc-type"]}
    if row["record_type"] == "revisit":
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        refers = int(fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
        return row | {"payload_bytes": int(_fields(http)["content-length"]), "payload_digest": digest, "refers_to": refers, "payload": None}
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None, "payload": payload}


# ---- ZIP packages

def _zip64_field(values: list[int]) -> bytes:
    return struct.pack("<HH", 1, 8 * len(values)) + struct.pack(f"<{len(values)}Q", *values) if values else b""


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False) -> int:
    """Write a ZIP file of stored members to a stream; returns its size.

    ``zip64`` writes the large forms even where the small ones would do.
    """
    directory, at = bytearray(), 0
    for name, data in members:
        title, crc = name.encode(), zlib.crc32(data)
        big = zip64 or len(data) >= LIMIT32
        size = LIMIT32 if big else len(data)
        extra = _zip64_field([len(data), len(data)] if big else [])
        head = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(title), len(extra))
        out.write(head + title + extra)
        out.write(data)
        far = zip64 or at >= LIMIT32
        extra = _zip64_field(([len(data), len(data)] if big else []) + ([at] if far else []))
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if big or far else 20, 0x800, 0, 0, 33, crc, size, size,
                                 len(title), len(extra), 0, 0, 0, 0, LIMIT32 if far else at)
        directory += title + extra
        at += len(head) + len(title) + (20 if big else 0) + len(data)
    start, count, end = at, len(members), bytearray()
    big = zip64 or start >= LIMIT32 or count >= LIMIT16
    if big:
        end += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), start)
        end += struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(directory), 1)
    small = (LIMIT16, LIMIT16, LIMIT32, LIMIT32) if big else (count, count, len(directory), start)
    end += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, *small, 0)
    out.write(bytes(directory + end))
    return start + len(directory) + len(end)


@dataclass(frozen=True)
class Member:
    name: str
    header_at: int
    size: int


def _at(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def central_directory(file, size: int) -> dict[str, Member]:
    """Stored members of an open, seekable ZIP file of ``size`` bytes."""
    tail_at = max(0, size - 22 - LIMIT16)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end-of-directory record: not a ZIP file")
    _, _, _, count, length, start = struct.unpack_from("<HHHHII", tail, end + 4)
    if LIMIT32 in (length, start) or count == LIMIT16:
        locator = end - 20
        if locator < 0 or tail[locator:locator + 4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        record_at = struct.unpack_from("<Q", tail, locator + 8)[0]
        record = _at(file, record_at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is missing")
        _, count, length, start = struct.unpack_from("<QQQQ", record, 24)
    directory, at, found = _at(file, start, length), 0, {}
    for _ in range(count):
        (sign, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, header_at) = struct.unpack_from(
            "<4sHHHHHHIIIHHHHHII", directory, at)
        if sign != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        name = directory[at + 46:at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                large = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = large.pop(0) if plain == LIMIT32 else plain
                packed = large.pop(0) if packed == LIMIT32 else packed
                header_at = large.pop(0) if header_at == LIMIT32 else header_at
            extra = extra[4 + n:]
        if method == 0:
            found[name] = Member(name, header_at, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(file, member: Member) -> int:
    head = _at(file, member.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("local header is missing")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


def range_read(file, size: int) -> Iterator[bytes]:
    """Raw records of a package, in index order, a range of neighbours at a time."""
    members = central_directory(file, size)
    index = members[INDEX]
    listed = [json.loads(line.split(b" ", 2)[2]) for line in _at(file, data_start(file, index), index.size).splitlines() if line]
    base, at = data_start(file, members[DATA]), 0
    while at < len(listed):
        first, upto = listed[at], at + 1
        while upto < len(listed) and listed[upto]["offset"] + listed[upto]["length"] - first["offset"] <= RANGE_BYTES:
            upto += 1
        last = listed[upto - 1]
        block = _at(file, base + first["offset"], last["offset"] + last["length"] - first["offset"])
        for entry in listed[at:upto]:
            start = entry["offset"] - first["offset"]
            yield gzip.decompress(block[start:start + entry["length"]])
        at = upto


# ---- Spark side

def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def with_revisits(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, url, html, refers_to).  Digests are grouped without the pages; pages are dealt by id, so no payload group is hot."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"),
                                                      F.octet_length(body).alias("n")).filter(F.col("n") >= min_shared)
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to")
    revisits = slim.join(groups.drop("least"), "digest").filter("page_id < refers_to").select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("_sha1"))
    return rows.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("_sha1") == F.col("_digest")), "left").select(
        "page_id", "url", "html", "refers_to")


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write packages below ``folder``; returns the table of those that count (path, records, bytes).

    A task names its packages afresh each time it runs.  Only packages that the committed table lists are ever read, so a task
    that was lost half-way leaves nothing but unlisted files.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        data, index = bytearray(), []

        def flush() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(name) as out:
                size = write_zip(out, [(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": [len(index)], "bytes": [size]})
            data.clear()
            index.clear()
            return done

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = gzip.compress(warc_record(page_id, url, (html or "").encode(), refers_to), 6, mtime=0)
                if data and len(data) + len(record) > package_bytes:
                    yield flush()
                place = {"url": url, "page": page_id, "offset": len(data), "length": len(record)}
                index.append(f"{'-' if page_id is None else page_id} 19700101000000 {json.dumps(place)}\n")
                data.extend(record)
        if index:
            yield flush()

    return write_scratch(small_batches(rows.select("page_id", "url", "html", "refers_to")).mapInArrow(thrifty(run), "path string, records long, bytes long"), "packages")


def read_packages(packages: DataFrame, payload: bool = False) -> DataFrame:
    """Rows of all records in the packages of a table with a ``path``; ``payload`` adds the bytes of responses."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [field.split()[0] for field in schema.split(", ")] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for raw in range_read(file, file.size()):
                        rows.append(parse_record(raw))
                        held += len(raw)
                        if held > RANGE_BYTES:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=arrow)

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(parts, "path").mapInArrow(thrifty(run), schema + ", payload binary" * payload)


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the packages it was written to."""
    packages = write_packages(with_revisits(read(spark, sf_dir, "pages")), scratch_path(spark, "wacz"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT body, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY body)
SELECT page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body AND p.n >= 1000
"""
