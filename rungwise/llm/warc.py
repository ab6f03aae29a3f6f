"""WARC archives, compressed record by record with a dictionary of their own (operator 2).

Writing: pages with equal payloads (by SHA-1 and length) of at least ``revisit_bytes`` get one
response record, that of the largest page id, and revisit records for the rest. Each task fills
archives of about ``archive_bytes`` of records in the shared folder. An archive's Zstandard
dictionary is trained on records spread evenly over that archive and stands, itself compressed, in
a leading skippable frame; every record is a frame of its own. A file carries a fresh name per
attempt and counts only if its row reaches the manifest, which Spark commits, so retried, doubled
and lost tasks leave at most unlisted files.

Reading: each task streams its archives, takes the dictionary from the leading frame, undoes one
frame at a time, and checks length and SHA-1 of every response payload against its header.

Defined cases: a null payload is empty; a null url leaves WARC-Target-URI out; pages with a null
id have no id field and revisit others as any page does, or are responses if their group has no
id at all; rows that repeat the largest id of a group are all responses; line breaks in a url are
escaped; an empty table gives no archive and no rows; other columns are ignored. A record and its
archive must fit in a worker's memory (``archive_bytes`` or one record, whichever is larger). Too
few or too small records for a dictionary give an archive without the leading frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import map_arrow, stored
from rungwise.session import scratch_path

# Fixed values of the two formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on records of about so many bytes for each of its own.
TRAINING_RATIO = 64
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6


def plan(pages: DataFrame, id_column: str, url: str, payload: str, revisit_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, record_type, refers_to) of every page."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    pages = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    # One row per payload, combined map-side; the join back is one the adaptive planner can split.
    first = (
        pages.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("top"))
        .select(F.col("digest").alias("d"), F.col("payload_bytes").alias("n"), "top")
    )
    same = (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n"))
    own = F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    return pages.join(first, same, "left").select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("top")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{i}:{digest}')}>"
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    fields += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The facts of one record; raises if a response's payload is not what its header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
    return {
        "page_id": fields.get("X-Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": fields.get("X-Refers-To-Page-Id"),
    }


def archive(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary's frame, then a frame for each record."""
    book = dictionary(records)
    if book is None:
        packer, out = zstandard.ZstdCompressor(level=LEVEL), []
    else:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=book)
        kept = zstandard.ZstdCompressor(level=19).compress(book.as_bytes())
        out = [struct.pack("<II", DICTIONARY_FRAME, len(kept)), kept]
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    total = sum(map(len, records))
    step = max(1, total // (DICTIONARY_BYTES * TRAINING_RATIO))
    samples = records[::step]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:  # samples too few or too alike to train on
        return None


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one frame at a time, holding one record and one chunk."""
    data = stream.read(chunk)
    book = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            data += stream.read(chunk)
        kept, data = data[8 : 8 + size], data[8 + size :]
        if kept[:4] == ZSTD_MAGIC:
            kept = zstandard.ZstdDecompressor().decompress(kept)
        book = zstandard.ZstdCompressionDict(kept, dict_type=zstandard.DICT_TYPE_FULLDICT)
    opener = zstandard.ZstdDecompressor(dict_data=book) if book else zstandard.ZstdDecompressor()
    while data := data or stream.read(chunk):
        one, out = opener.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise EOFError("the archive ends inside a record")
        yield b"".join(out)


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url: str = "url",
    payload: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Write all pages; the manifest (path, records, bytes) of the archives, one row each."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    planned = plan(pages, id_column, url, payload, revisit_bytes)

    def save(records: list[bytes]) -> pa.RecordBatch:
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        name, data = f"{uuid.uuid4().hex}.warc.zst", archive(records)
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
        return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "records": [len(records)], "bytes": [len(data)]})

    def kernel(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, where, body, digest, _, kind, refers_to = row
                held.append(record(page_id, where, body, digest, kind, refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield save(held)
                    held, size = [], 0
        if held:
            yield save(held)

    return stored(map_arrow(planned, kernel, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with ``payloads`` the payload of responses."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    limit = 4 << 20

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def kernel(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = _opened(path)
                rows, size = [], 0
                with store.open_input_stream(place) as stream:
                    for data in frames(stream):
                        rows.append(parse(data))
                        size += len(data) if payloads else 256
                        if size >= limit:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    types = ["string", "string", "long", "string", "string", "string", "binary"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=False))
    # Deal the archives out: the manifest itself is one small file.
    parts = max(1, min(manifest.count(), 10_000))
    found = map_arrow(manifest.select("path").repartition(parts), kernel, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
