"""Label verification: resolution logs joined to conditions and blocks, then classified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.chain import hex_bytes
from rungwise.functions.times import block_ranges
from rungwise.operators.asof import first_at_or_after
from rungwise.operators.ordered import percentiles, side_by_side

DAY_MICROS = 86_400 * 1_000_000

# The reason recorded with each status.
MISSING = "no ConditionResolution log in the configured window"
REMOVED = "the only resolution log is removed or lacks finality state"
EARLY = "resolution block predates the scheduled target"
LATE = "resolution block is later than the protocol target-plus-grace deadline"
AGREED = "canonical payout agrees with Gamma candidate"
UNKNOWN_BLOCK = "the block of the only resolution log is not in the block table"
DISAGREED = "canonical payout disagrees with Gamma candidate"


def search_windows(conditions: DataFrame, grace_seconds: int) -> DataFrame:
    """Add the microsecond window ``[day, day + 1 day + grace)`` searched for each condition."""
    day = F.unix_micros(F.date_trunc("day", "target_at"))
    return conditions.withColumns(
        {"window_start": day, "window_end": day + DAY_MICROS + grace_seconds * 1_000_000}
    )


def logs_in_window(logs: DataFrame, conditions: DataFrame, grace_seconds: int) -> DataFrame:
    """Logs of requested conditions whose block lies in the condition's window.

    An equi-join on the condition with the range as residual; collapse copies of a log first.
    ``logs`` carries ``block_ts``; a log whose block is unknown (null) cannot be placed and stays.
    """
    windows = search_windows(conditions, grace_seconds).select(
        "condition_id", "window_start", "window_end"
    )
    at = F.unix_micros("block_ts")
    return logs.join(windows, "condition_id").where(
        at.isNull() | ((at >= F.col("window_start")) & (at < F.col("window_end")))
    ).drop("window_start", "window_end")


def attach_blocks(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block time of every log, and whether the block's hash is the one the log names.

    Both are null for a log whose block is not in ``blocks``; no log is lost.
    """
    known = blocks.select(
        F.col("number").alias("block_number"),
        F.col("hash").alias("_hash"),
        F.col("ts").alias("block_ts"),
    )
    return (
        logs.join(known, "block_number", "left")
        .withColumn("hash_matches", F.col("_hash") == F.col("block_hash"))
        .drop("_hash")
    )


def unknown_blocks(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Violations: blocks that logs name and the block table lacks, with the number of logs."""
    known = blocks.select(F.col("number").alias("block_number"))
    missing = logs.join(known, "block_number", "left_anti")
    return missing.groupBy("block_number").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("block_unknown").alias("rule_id"),
        F.coalesce(F.col("block_number").cast("string"), F.lit("")).alias("key"),
        F.concat(F.col("n").cast("string"), F.lit(" logs")).alias("detail"),
    )


def hash_mismatches(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    known = blocks.select(F.col("number").alias("block_number"), F.col("hash").alias("canonical"))
    return logs.join(known, "block_number").where(F.col("canonical") != F.col("block_hash"))


def distinct_logs(logs: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Logs reduced to one per identity; ``conflict`` marks identities with several contents."""
    rest = [c for c in logs.columns if c not in identity]
    content = F.struct(*rest)
    return (
        logs.groupBy(*identity)
        .agg(
            F.min(content).alias("v"),
            F.count(F.lit(1)).alias("copies"),
            (F.min(content) != F.max(content)).alias("conflict"),
        )
        .select(*identity, "v.*", "copies", "conflict")
    )


def log_filter_problems(
    logs: DataFrame, conditions: DataFrame, address: str, topic: str
) -> DataFrame:
    """Raw logs that do not answer the request: address, topics or condition differ."""
    checked = logs.select(
        "*",
        hex_bytes("address", 20).alias("_address"),
        hex_bytes(F.try_element_at("topics", F.lit(1)), 32).alias("_topic"),
        hex_bytes(F.try_element_at("topics", F.lit(2)), 32).alias("_condition"),
    )
    known = conditions.select(F.col("condition_id").alias("_condition"), F.lit(True).alias("_known"))
    problem = (
        F.when(~F.col("_address").eqNullSafe(F.lit(address.lower())), "different_address")
        .when(F.coalesce(F.size("topics"), F.lit(0)) < 2, "fewer_than_two_topics")
        .when(~F.col("_topic").eqNullSafe(F.lit(topic.lower())), "different_topic")
        .when(F.col("_known").isNull(), "condition_not_requested")
    )
    joined = checked.join(known, "_condition", "left").withColumn("problem", problem)
    return joined.where("problem is not null").drop("_address", "_topic", "_condition", "_known")


LOG_FIELDS = ("removed", "slot_count", "payouts", "block_ts", "hash_matches")
#: What an agreed condition cites: fields of its log -> columns of the evidence.
CITED = {
    "payouts": "payout_vector",
    "block_number": "resolution_block_number",
    "block_hash": "resolution_block_hash",
    "block_ts": "resolution_block_timestamp",
    "tx_hash": "resolution_tx_hash",
    "log_index": "resolution_log_index",
    "source_sha256": "chain_source_sha256",
}


def one_log_per_condition(unique_logs: DataFrame) -> DataFrame:
    """Number of distinct logs per condition and the content of one of them."""
    cited = [c for c in CITED if c in unique_logs.columns and c not in LOG_FIELDS]
    content = F.struct(*LOG_FIELDS, *cited)
    return unique_logs.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("n_logs"), F.min(content).alias("log")
    )


def classify(conditions: DataFrame, unique_logs: DataFrame, grace_seconds: int) -> DataFrame:
    """Status and reason per condition, first matching rule wins.

    ``conditions``: ``condition_id, target_at, candidate``; ``unique_logs``: one row per distinct
    log with ``condition_id, removed, slot_count, payouts (null when undecodable), block_ts,
    hash_matches``, and optionally the other fields of ``CITED``, which agreed conditions keep under
    the evidence's names. An otherwise usable log of a block with another hash is fatal; one of an
    unknown block cannot be placed in time and leaves its condition ambiguous.
    """
    one = one_log_per_condition(unique_logs)
    fields = one.schema["log"].dataType.names
    joined = conditions.join(one, "condition_id", "left")
    log = {name: F.col(f"log.{name}") for name in fields}
    log["payouts"] = log["payouts"].cast("array<string>")
    yes, no = F.array(F.lit("1"), F.lit("0")), F.array(F.lit("0"), F.lit("1"))
    is_yes, is_no = log["payouts"] == yes, log["payouts"] == no
    known = F.coalesce((log["slot_count"] == 2) & (is_yes | is_no), F.lit(False))
    at, target = F.unix_micros(log["block_ts"]), F.unix_micros("target_at")
    late = at > target + grace_seconds * 1_000_000
    label = F.when(is_yes, 1.0).otherwise(0.0)
    n = F.col("n_logs")

    rules: list[tuple[Column, str | Column, Column]] = [
        (n.isNull(), "missing", F.lit(MISSING)),
        (
            n > 1,
            "ambiguous",
            F.concat(F.lit("found "), n.cast("string"), F.lit(" distinct ConditionResolution logs")),
        ),
        (~log["removed"].eqNullSafe(F.lit(False)), "ambiguous", F.lit(REMOVED)),
        (log["payouts"].isNull(), "ambiguous", F.lit("invalid ConditionResolution ABI")),
        (
            ~known,
            "ambiguous",
            F.concat(
                F.lit("unsupported payout vector ["),
                F.concat_ws(", ", log["payouts"]),
                F.lit("]"),
            ),
        ),
        (log["block_ts"].isNull(), "ambiguous", F.lit(UNKNOWN_BLOCK)),
        (
            ~log["hash_matches"],
            F.raise_error(F.lit("canonical block hash mismatch")),
            F.lit("canonical block hash mismatch"),
        ),
        (at < target, "ambiguous", F.lit(EARLY)),
        (late, "ambiguous", F.lit(LATE)),
        (label != F.col("candidate"), "gamma_disagreement", F.lit(DISAGREED)),
    ]
    status, reason = None, None
    for test, name, text in rules:
        status = F.when(test, name) if status is None else status.when(test, name)
        reason = F.when(test, text) if reason is None else reason.when(test, text)
    agreed = F.col("status") == "agreed"

    def cited(field: str) -> Column:
        # The payouts of an agreed condition are 1 and 0.
        return log[field].cast("array<int>") if field == "payouts" else log[field]

    return (
        joined.withColumn("status", status.otherwise("agreed"))
        .withColumn("reason", reason.otherwise(F.lit(AGREED)))
        .withColumn("label", F.when(agreed, label))
        .withColumns({CITED[f]: F.when(agreed, cited(f)) for f in CITED if f in fields})
        .drop("log", "n_logs")
    )


def exclusions(resolutions: DataFrame) -> DataFrame:
    """Conditions that were not agreed, with status and reason."""
    return resolutions.where(F.col("status") != "agreed").select("condition_id", "status", "reason")


def candidate_conflicts(rows: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """Conditions whose candidate metadata is not constant over their rows."""
    content = F.struct(*metadata)
    return (
        rows.groupBy("condition_id")
        .agg((F.min(content) != F.max(content)).alias("bad"))
        .where("bad")
        .select("condition_id")
    )


def one_row_per_condition(rows: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """Reduce candidate rows to their conditions (consistency is checked separately)."""
    content = F.struct(*metadata)
    picked = rows.groupBy("condition_id").agg(F.min(content).alias("v"))
    return picked.select("condition_id", "v.*")


def search_summary(
    conditions: DataFrame, blocks: DataFrame, grace_seconds: int, span: int
) -> DataFrame:
    """Per target day: conditions, searched block bounds, clamping and number of ranges.

    Block bounds come from the mirrored as-of join against the block table, for one row per day.
    """
    days = (
        conditions.groupBy(F.date_trunc("day", "target_at").alias("start_at"))
        .agg(F.count(F.lit(1)).alias("condition_count"))
        .withColumn(
            "end_at",
            F.timestamp_micros(
                F.unix_micros("start_at") + DAY_MICROS + grace_seconds * 1_000_000
            ),
        )
    )
    asked = days.select(F.col("start_at").alias("at")).union(days.select("end_at")).distinct()
    bounds = first_at_or_after(blocks, asked)
    head = blocks.agg(
        F.max("number").alias("number"), F.unix_micros(F.max("ts")).alias("at")
    ).first()
    first = bounds.select(F.col("at").alias("start_at"), F.col("number").alias("from_block"))
    last = bounds.select(F.col("at").alias("end_at"), F.col("number").alias("after_block"))
    table = days.join(first, "start_at").join(last, "end_at")
    clamped = F.unix_micros("end_at") > head["at"]
    to_block = F.when(clamped, head["number"]).otherwise(F.col("after_block") - 1)
    return (
        table.withColumn("clamped", clamped)
        .withColumn("to_block", to_block)
        .withColumn("ranges", F.size(block_ranges("from_block", "to_block", span)).cast("bigint"))
        .select("start_at", "condition_count", "clamped", "from_block", "to_block", "ranges")
    )


def latency_profile(resolutions: DataFrame) -> DataFrame:
    """Delay of the label behind its target: extremes and linear-interpolation percentiles."""
    marks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    extremes = resolutions.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("delay_seconds").alias("min"),
        F.max("delay_seconds").alias("max"),
    )
    return side_by_side(extremes, percentiles(resolutions, [], "delay_seconds", marks))


def event_spread(resolutions: DataFrame) -> DataFrame:
    """Spread of label times within an event."""
    return resolutions.groupBy("event_id").agg(
        (F.max("delay_seconds") - F.min("delay_seconds")).alias("delay_seconds")
    )
