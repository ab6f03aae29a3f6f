from __future__ import annotations

import hashlib
import io
import struct

import zstandard

from rungwise.llm import warc

LONG = "<p>" + "same words " * 200 + "</p>"
ROWS = [
    (1, "http://a/1", LONG, "x"),
    (2, "http://a/2", LONG, "x"),
    (9, None, LONG, "x"),
    (9, "http://a/9", LONG, "x"),
    (3, "http://a/3\r\nX: y", "short", "x"),
    (4, "http://a/4", "short", "x"),
    (5, "http://ä/5", None, "x"),
    (6, "http://a/6", "", "x"),
    (7, "http://a/7", "ü\r\n\r\n漢" * 500, "x"),
    (None, "http://a/n", LONG, "x"),
    (None, "http://a/n", "only " * 300, "x"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    out = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        twins = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        top = max(twins, default=None) if len(body) >= 1000 else None
        own = top is None or page_id == top
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


def got(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_round_trip_over_many_archives(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    manifest = warc.write(pages, archive_bytes=3000)
    assert manifest.count() > 1
    read = warc.read(manifest, payloads=True)
    assert got(read) == expected(ROWS)
    bodies = {r.page_id: bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert bodies[7] == ROWS[8][2].encode() and bodies[5] == b"" and bodies[9] == LONG.encode()
    assert {r.url for r in read.where("page_id = 3").collect()} == {"http://a/3%0D%0AX: y"}


def test_empty_table(spark):
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_dictionary_leads_and_every_record_is_a_frame():
    records = [warc.record(i, f"http://h/{i}", f"<html>{'text %d ' % i * 40}</html>".encode(), "00" * 20, "response", None) for i in range(300)]
    data = warc.archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    book = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert 1024 <= len(book) <= warc.DICTIONARY_BYTES
    assert list(warc.frames(io.BytesIO(data), chunk=700)) == records
    # An ordinary reader skips the dictionary; with it in hand the first frame is the first record.
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book)).decompressobj()
    assert opener.decompress(data[8 + size :]) == records[0]
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(data) < plain


def test_few_records_need_no_dictionary():
    assert warc.archive([b"one"])[:4] == warc.ZSTD_MAGIC
    assert list(warc.frames(io.BytesIO(warc.archive([b"one", b"two"])))) == [b"one", b"two"]
