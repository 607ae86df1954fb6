import hashlib
import io
import struct
import zipfile

import pytest

from shopfloor.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to long, value string"


def reader(data):
    asked = []

    def read(at, n):
        asked.append((at, n))
        assert at >= 0 and at + n <= len(data)
        return data[at:at + n]
    return warc.ZipReader(read, len(data)), asked


def test_reads_what_zipfile_writes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"hello world")
        z.writestr("ü/b.bin", b"x" * 1000)
        z.comment = b"PK\x05\x06 not the end"
    r, asked = reader(out.getvalue())
    assert r.range("a.txt", 6, 5) == b"world" and r.range("ü/b.bin") == b"x" * 1000
    assert max(n for _, n in asked[1:]) <= 1000 and sum(n for at, n in asked if at == 30 + 5) <= 11
    with pytest.raises(ValueError):
        r.range("a.txt", 6, 6)


def test_zip64_directory():
    """A package whose counts, sizes and offsets stand in ZIP64 records only."""
    name, data = b"archive/data.warc.gz", b"0123456789"
    local = b"PK\x03\x04" + struct.pack("<5H3L2H", 45, 0, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + \
        struct.pack("<2H2Q", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = b"PK\x01\x02" + struct.pack("<6H3L5H2L", 45, 45, 0, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name),
                                         len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\x06\x07" + struct.pack("<LQL", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<4H2LH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    r, _ = reader(local + central + end64 + locator + end)
    assert r.members == {name.decode(): (0, 10, 0)} and r.range(name.decode(), 3, 4) == b"3456"


def test_refuses_deflated_members_and_other_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.INDEX, b"0 0 10\n" * 50)
    with pytest.raises(ValueError, match="compressed"):
        list(reader(out.getvalue())[0].records())
    with pytest.raises(ValueError, match="not a ZIP"):
        reader(b"plain text, no archive at all")


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(zip64):
    import gzip
    payload = "é\r\n\r\nWARC/1.1\r\n".encode() * 100
    sha = hashlib.sha1(payload).hexdigest()
    records = [("7", gzip.compress(warc.warc_record(7, "http://x/a b\r\n", payload, sha, None))),
               ("", gzip.compress(warc.warc_record(None, None, payload, sha, 7)))]
    r, _ = reader(warc.build_archive(records, zip64) + b"\n")
    a, b = map(warc.parse_record, r.records())
    assert a == {"page_id": 7, "url": "http://x/a%20b%0D%0A", "payload": payload, "payload_bytes": len(payload),
                 "payload_digest": sha, "record_type": "response", "refers_to": None}
    assert (b["page_id"], b["url"], b["payload"], b["payload_bytes"], b["record_type"], b["refers_to"]) == (
        None, None, None, len(payload), "revisit", 7)


def test_spark_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    big = "<p>é</p>" * 200
    rows = [(1, "u1", big), (9, "u9", big), (4, None, big), (None, "n", big), (5, "u5", "small"), (6, "u6", "small"),
            (7, "u7", None), (8, "u8", ""), (9, "u9", big), (10, "u10", "y" * 999), (11, "u11", "y" * 999),
            (12, "x", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d", 3, "v") for r in rows], SCHEMA)
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        to = 9 if h == big and i != 9 else None
        want.append((i, u, None if to else data, len(data), hashlib.sha1(data).hexdigest(),
                     "revisit" if to else "response", to))
    key = lambda r: (r[0] or 0, str(r[1]))
    assert sorted(((r[0], r[1], None if r[2] is None else bytes(r[2]), *r[3:]) for r in got), key=key) == sorted(want, key=key)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 1 and all(zipfile.ZipFile(f).testzip() is None for f in files)


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
