"""Manifest records, resolution logs, block headers and artifact digests as tables."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.functions.chain import hex_bytes, is_digest, quantity, resolution_payload
from rungwise.functions.documents import history_request_ok, page_request_ok, safe_archive_path

# Response sources and the folder each is archived under.
EVENT_SOURCE = "gamma.events_keyset"
HISTORY_SOURCE = "clob.batch_prices_history"
FOLDERS = {EVENT_SOURCE: "gamma", HISTORY_SOURCE: "clob"}
# Methods a response log may hold.
LOG_METHOD, BLOCK_METHOD = "eth_getLogs", "eth_getBlockByNumber"
METHODS = ("eth_chainId", "eth_blockNumber", BLOCK_METHOD, LOG_METHOD)

RECORD_SCHEMA = (
    "raw_responses array<struct<path:string, source:string, "
    "request:struct<method:string, url:string, body:string, body_sha256:string>, "
    "archived_at_utc:string, content_bytes:bigint, content_sha256:string, "
    "gzip_bytes:bigint, gzip_sha256:string>>"
)
BODY = "end_ts bigint, fidelity bigint, markets array<string>, start_ts bigint"
CHUNK_BYTES = 1 << 20


def response_records(manifests: DataFrame, body: str = "body") -> DataFrame:
    """One row per archived response of each manifest."""
    parsed = manifests.select(F.from_json(body, RECORD_SCHEMA).alias("m"))
    records = parsed.select(F.posexplode("m.raw_responses").alias("index", "r"))
    flat = records.select("index", "r.*")
    return flat.select(
        "index",
        "path",
        "source",
        F.col("request.method").alias("method"),
        F.col("request.url").alias("url"),
        F.col("request.body").alias("request_body"),
        F.col("request.body_sha256").alias("body_sha256"),
        "archived_at_utc",
        "content_bytes",
        "content_sha256",
        "gzip_bytes",
        "gzip_sha256",
    )


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files, one document per row."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def response_problems(
    records: DataFrame,
    page_endpoint: str,
    title_search: str,
    history_endpoint: str,
    fidelity: int,
    window_seconds: int,
) -> DataFrame:
    """Violations of the provenance rules: shape of each record, unique paths and requests."""
    event = F.col("source") == EVENT_SOURCE
    history = F.col("source") == HISTORY_SOURCE
    folder = F.when(event, FOLDERS[EVENT_SOURCE]).when(history, FOLDERS[HISTORY_SOURCE])
    page_ok = (F.col("method") == "GET") & page_request_ok("url", page_endpoint, title_search)
    body_ok = (
        (F.col("method") == "POST")
        & (F.col("url") == history_endpoint)
        & history_request_ok("request_body", "body_sha256", fidelity, window_seconds)
    )
    rules = {
        "unknown_source": ~(event | history),
        "unsafe_path": ~safe_archive_path("path", folder),
        "bad_content_digest": ~is_digest("content_sha256"),
        "bad_gzip_digest": ~is_digest("gzip_sha256"),
        "non_positive_size": (F.col("content_bytes") <= 0) | (F.col("gzip_bytes") <= 0),
        "archived_at_not_utc": ~F.coalesce(
            F.col("archived_at_utc").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"),
            F.lit(False),
        ),
        "bad_event_request": event & ~page_ok,
        "bad_history_request": history & ~body_ok,
    }
    fired = F.array_compact(
        F.array(*[F.when(F.coalesce(t, F.lit(True)), n) for n, t in rules.items()])
    )
    per_record = records.select(F.col("path").alias("key"), F.explode(fired).alias("rule_id"))
    signature = F.concat_ws("|", "method", "url", "body_sha256")

    def repeated(value, rule):
        counted = records.groupBy(value.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return counted.where("n > 1").select("key", F.lit(rule).alias("rule_id"))

    merged = per_record.unionByName(repeated(F.col("path"), "path_repeated")).unionByName(
        repeated(signature, "request_repeated")
    )
    return merged.select("rule_id", "key", F.lit("").alias("detail"))


RECORD_FIELDS = {
    "": ("path", "source", "request", "archived_at_utc", "content_bytes", "content_sha256", "gzip_bytes", "gzip_sha256"),
    "request": ("method", "url", "body", "body_sha256"),
}


def record_field_problems(manifests: DataFrame, body: str = "body") -> DataFrame:
    """Records with other fields than the closed set: parsing by schema would drop them silently.

    Read as maps of raw JSON, so every field of a record is seen. A request may lack a body.
    """
    raw = F.from_json(body, "raw_responses array<map<string,string>>")["raw_responses"]
    records = manifests.select(F.posexplode(raw).alias("index", "r"))
    key = F.coalesce(F.element_at("r", F.lit("path")), F.concat(F.lit("record "), F.col("index").cast("string")))
    inner = F.coalesce(F.json_object_keys(F.element_at("r", F.lit("request"))), F.array().cast("array<string>"))

    def names(values: list[str]):
        return F.array(*[F.lit(v) for v in values])

    outer_names, inner_names = names(RECORD_FIELDS[""]), names(RECORD_FIELDS["request"])
    needed = names([n for n in RECORD_FIELDS["request"] if not n.startswith("body")])
    found = {
        "unexpected_field": F.concat(
            F.array_except(F.map_keys("r"), outer_names),
            F.transform(F.array_except(inner, inner_names), lambda n: F.concat(F.lit("request."), n)),
        ),
        "missing_field": F.concat(
            F.array_except(outer_names, F.map_keys("r")),
            F.transform(F.array_except(needed, inner), lambda n: F.concat(F.lit("request."), n)),
        ),
    }
    parts = [
        records.select(F.lit(rule).alias("rule_id"), key.alias("key"), F.explode(fields).alias("detail"))
        for rule, fields in found.items()
    ]
    return parts[0].unionByName(parts[1])


def method_problems(responses: DataFrame) -> DataFrame:
    """Entries of a response log whose method is not one of ``METHODS``."""
    allowed = F.coalesce(F.col("method").isin(*METHODS), F.lit(False))
    bad = responses.where(~allowed).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return bad.select(
        F.lit("method_not_allowed").alias("rule_id"),
        F.coalesce("method", F.lit("")).alias("key"),
        F.concat(F.col("n").cast("string"), F.lit(" responses")).alias("detail"),
    )


def requested_tokens(records: DataFrame) -> DataFrame:
    """``(content_sha256, token)`` pairs named by history requests."""
    body = F.from_json("request_body", BODY)
    return records.where(F.col("source") == HISTORY_SOURCE).select(
        "content_sha256", F.explode(body["markets"]).alias("token")
    )


def resolution_logs(raw: DataFrame) -> DataFrame:
    """Typed logs: hex normalised, quantities decoded, payload decoded (null when invalid)."""
    payload = resolution_payload("data")
    return raw.select(
        hex_bytes(F.try_element_at("topics", F.lit(2)), 32).alias("condition_id"),
        hex_bytes("blockHash", 32).alias("block_hash"),
        hex_bytes("transactionHash", 32).alias("tx_hash"),
        quantity("logIndex").alias("log_index"),
        quantity("blockNumber").alias("block_number"),
        "removed",
        payload["slot_count"].alias("slot_count"),
        payload["payouts"].alias("payouts"),
    )


def block_headers(raw: DataFrame) -> DataFrame:
    return raw.select(
        quantity("number").alias("number"),
        hex_bytes("hash", 32).alias("hash"),
        F.timestamp_seconds(quantity("timestamp")).alias("ts"),
    )


def bundle_problems(bundles: DataFrame, responses: DataFrame, domain: str) -> DataFrame:
    """Evidence bundles ``(digest, log_sha256, block_sha256)`` that do not hold.

    Cited responses must exist with the right method, log first and block second; the digest must
    follow from both and be unique.
    """
    from rungwise.functions.chain import evidence_digest

    def known(method: str, name: str) -> DataFrame:
        return (
            responses.groupBy(F.col("response_sha256").alias(name))
            .agg(F.max(F.col("method") == method).alias(f"{name}_ok"))
        )

    joined = (
        bundles.join(known(LOG_METHOD, "log_sha256"), "log_sha256", "left")
        .join(known(BLOCK_METHOD, "block_sha256"), "block_sha256", "left")
    )
    rules = {
        "bundle_log_absent": F.col("log_sha256_ok").isNull(),
        "bundle_block_absent": F.col("block_sha256_ok").isNull(),
        "bundle_order": ~F.coalesce("log_sha256_ok", F.lit(True))
        | ~F.coalesce("block_sha256_ok", F.lit(True)),
        "bundle_digest": F.col("digest") != evidence_digest(domain, "log_sha256", "block_sha256"),
    }
    fired = F.array_compact(F.array(*[F.when(t, n) for n, t in rules.items()]))
    per_bundle = joined.select(F.col("digest").alias("key"), F.explode(fired).alias("rule_id"))
    copies = bundles.groupBy(F.col("digest").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    repeated = copies.where("n > 1").select("key", F.lit("bundle_repeated").alias("rule_id"))
    return per_bundle.unionByName(repeated).select("rule_id", "key", F.lit("").alias("detail"))


def _unpacked_digest(content: bytes) -> str:
    digest = hashlib.sha256()
    with gzip.open(io.BytesIO(content), "rb") as stream:
        while chunk := stream.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unpacked = [
            _unpacked_digest(content.as_py()) if path.as_py().endswith(".gz") else None
            for path, content in zip(batch["path"], batch["content"], strict=True)
        ]
        kept = batch.select(["path", "bytes", "sha256"])
        yield kept.append_column("content_sha256", pa.array(unpacked, pa.string()))


def artifact_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of the bytes, and of the decompressed bytes of gzip files, for every file.

    File digests are computed by Spark; only decompression needs Python, one chunk at a time.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(
            "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content"
        )
    )
    return files.mapInArrow(
        _digest_batches, "path string, bytes bigint, sha256 string, content_sha256 string"
    )


def archive_audit(records: DataFrame, digests: DataFrame) -> DataFrame:
    """Recorded responses that are absent, changed, or present without a record.

    ``digests.path`` must be relative, as in the records.
    """
    found = digests.select(
        "path",
        F.col("sha256").alias("found_gzip"),
        F.col("content_sha256").alias("found_content"),
    )
    joined = records.select("path", "gzip_sha256", F.col("content_sha256").alias("declared")).join(
        found, "path", "full_outer"
    )
    problem = (
        F.when(F.col("found_gzip").isNull(), "response_absent")
        .when(F.col("gzip_sha256").isNull(), "response_unrecorded")
        .when(F.col("gzip_sha256") != F.col("found_gzip"), "gzip_digest_differs")
        .when(~F.col("declared").eqNullSafe(F.col("found_content")), "content_digest_differs")
    )
    return joined.select(
        problem.alias("rule_id"), F.col("path").alias("key"), F.lit("").alias("detail")
    ).where("rule_id is not null")
