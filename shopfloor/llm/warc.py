r"""WARC records in ZIP packages, read back by ranges without extraction.

Writing: every page is one gzip member holding one WARC record. The members of
an archive are concatenated (``archive/data.warc.gz``) and indexed by offset
and length (``indexes/index.cdx``), and both are stored, not deflated, in one
ZIP file of bounded size. Spark's text sink writes each archive as a file of
its own to any file system Spark knows; the line end that the sink adds is
declared as the ZIP comment, so the files are valid ZIP packages.

Reading: the end-of-central-directory record, the ZIP64 locator and directory
and the central directory lead to the stored index and archive members; each
index entry is one range read of the archive member.

Records with equal payloads of at least ``MIN_REVISIT_BYTES`` are stored once:
the one with the largest page_id is a response, the others are revisits.

Defined cases: null html is an empty payload; a null url leaves out the target
URI; a null page_id is smallest (if all equal payloads lack one, all are
responses); rows that repeat the largest page_id are all responses; control
characters in a url are percent-encoded; a payload beyond the archive bound is
an archive of its own; an empty table writes no archive and reads as no rows;
columns other than page_id, url and html are not read. A package is fetched as one
value by Spark's binary reader, which refuses files of 2 GB and more, and is then
read by ranges; packages written here are bounded far below that.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 4 << 20  # compressed records per archive
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page:"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head but not the body."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, rest


def parse_record(data: bytes) -> dict:
    """The record's page_id, url, payload (None for a revisit), payload_bytes,
    payload_digest, record_type and refers_to."""
    h, rest = _headers(data)
    block = rest[:int(h["content-length"])]
    if len(block) != int(h["content-length"]):
        raise ValueError("truncated WARC record")
    http, payload = _headers(block)
    number = lambda v: int(v) if v else None
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    response = h["warc-type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {h['warc-record-id']} does not match")
    return {"page_id": number(h["warc-record-id"][len(_ID) + 1:-1]), "url": h.get("warc-target-uri"),
            "payload": payload if response else None, "payload_bytes": int(http["content-length"]),
            "payload_digest": digest, "record_type": h["warc-type"],
            "refers_to": None if response else number(h["warc-refers-to"][len(_ID) + 1:-1])}


def build_archive(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP package of (page id, compressed record), without its one-byte comment."""
    index, at = [], 0
    for page_id, data in records:
        index.append(f"{page_id} {at} {len(data)}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(d for _, d in records)), (INDEX, "".join(index).encode())):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as member:
                member.write(data)
        z.comment = b"\n"
    return out.getvalue()[:-1]


class ZipReader:
    """Directory of a ZIP package behind ``read(offset, length)``; members are
    range-read in place."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 22 - 65535)
        tail = read(tail_at, size - tail_at)
        at = len(tail) - 22
        while at >= 0 and not (tail[at:at + 4] == b"PK\x05\x06"
                               and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at -= 1
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        disk, cd_disk, _, n, cd_size, cd_at = struct.unpack_from("<4H2L", tail, at + 4)
        if 0xFFFF in (disk, cd_disk, n) or 0xFFFFFFFF in (cd_size, cd_at):
            locator = read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("ZIP64 locator is missing")
            end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end of central directory is missing")
            disk, cd_disk, _, n, cd_size, cd_at = struct.unpack_from("<2L4Q", end, 16)
        if disk or cd_disk:
            raise ValueError("packages of several disks are not supported")
        self.members: dict[str, tuple[int, int, int]] = {}  # name: method, stored size, local header
        cd, p = read(cd_at, cd_size), 0
        for _ in range(n):
            if cd[p:p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<2H", cd, p + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<2L3H", cd, p + 20)
            local = struct.unpack_from("<L", cd, p + 42)[0]
            name = cd[p + 46:p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = cd[p + 46 + n_name:p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, q)
                if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    local = next(values) if local == 0xFFFFFFFF else local
                q += 4 + length
            self.members[name] = (method, packed, local)
            p += 46 + n_name + n_extra + n_comment

    def range(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        header = self.read(local, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        length = size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError(f"range outside {name}")
        return self.read(local + 30 + sum(struct.unpack_from("<2H", header, 26)) + offset, length)

    def records(self) -> Iterator[bytes]:
        """The WARC records, each one range read at its index entry."""
        for line in self.range(INDEX).splitlines():
            _, offset, length = line.split(b" ")
            yield gzip.decompress(self.range(ARCHIVE, int(offset), int(length)))


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response)."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                     F.encode(common.text_or_empty("html"), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    equal = (p.where(F.length("payload") >= MIN_REVISIT_BYTES).groupBy("digest")
             .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return p.join(equal, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages' WARC records as ZIP packages under ``path``."""

    def pack(batches):
        held, size = [], 0

        def archive():
            # raw bytes in a string column: the text sink writes them unchanged
            data = build_archive(held)
            ends = pa.array([0, len(data)], pa.int32()).buffers()[1]
            return pa.RecordBatch.from_arrays(
                [pa.StringArray.from_buffers(1, ends, pa.py_buffer(data))], ["value"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                record = gzip.compress(warc_record(page_id, url, payload, digest, refers), 1, mtime=0)
                held.append(("" if page_id is None else str(page_id), record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    (with_record_types(pages).mapInArrow(pack, "value string")
     .write.option("maxRecordsPerFile", 1).text(path))


_READ = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all packages under ``path``; without ``payload`` that column is null."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * ARCHIVE_BYTES))

    def unpack(batches):
        for b in batches:
            for data in b.column(0):
                view = memoryview(data.as_buffer())
                rows = []
                for r in ZipReader(lambda at, n: bytes(view[at:at + n]), len(view)).records():
                    row = parse_record(r)
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) == common.ARROW_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .where(F.col("length") > 0).select("content").mapInArrow(unpack, _READ))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).drop("url", "payload")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND keep <> page_id THEN keep END AS refers_to
FROM m
"""
