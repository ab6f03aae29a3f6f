"""Verify candidate labels against resolution logs and keep completely agreed events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.config import Protocol
from rungwise.operators import coverage, labels
from rungwise.operators.quality import DataQualityError
from rungwise.session import checkpointed

LOG_IDENTITY = ("condition_id", "block_hash", "tx_hash", "log_index")


@dataclass
class Verification:
    resolutions: DataFrame
    rows: DataFrame
    retained: DataFrame
    coverage: DataFrame


def verify_labels(
    candidates: DataFrame,
    logs: DataFrame,
    blocks: DataFrame,
    pre_coverage: DataFrame,
    protocol: Protocol,
    unknown_blocks: str = "raise",
) -> Verification:
    """``candidates``: ``event_id, condition_id, split, horizon_seconds, target_at, candidate``.

    A requested log whose block is not in ``blocks`` is fatal, or with ``unknown_blocks="report"``
    leaves its condition ambiguous. ``rows`` carries the cited evidence of agreed conditions.
    """
    if unknown_blocks not in ("raise", "report"):
        raise ValueError("unknown_blocks is raise or report")
    metadata = ["event_id", "target_at", "split", "candidate"]
    if not labels.candidate_conflicts(candidates, metadata).isEmpty():
        raise DataQualityError("a condition has conflicting candidate metadata")
    conditions = labels.one_row_per_condition(candidates, metadata)
    grace = protocol.resolution_grace_seconds
    # Copies collapse before the joins, so a much repeated log stays one row.
    timed = labels.attach_blocks(labels.distinct_logs(logs, LOG_IDENTITY), blocks)
    unique = labels.logs_in_window(timed, conditions.select("condition_id", "target_at"), grace)
    if unknown_blocks == "raise" and not unique.where("block_ts is null").isEmpty():
        raise DataQualityError("a resolution log cites a block that is not in the block table")
    guarded = unique.withColumn(
        "removed",
        F.when(~F.col("conflict"), F.col("removed")).otherwise(
            F.raise_error(F.lit("conflicting duplicate log"))
        ),
    )
    resolutions = checkpointed(labels.classify(conditions, guarded, grace))
    cited = [c for c in labels.CITED.values() if c in resolutions.columns]
    rows = candidates.join(
        resolutions.select(
            "condition_id", "status", "reason", F.col("label").alias("chain_label"), *cited
        ),
        "condition_id",
    )
    kept = coverage.complete_agreed_events(rows)
    retained = rows.join(kept, [*coverage.CELL, "event_id"], "left_semi")
    return Verification(
        resolutions, rows, retained, coverage.label_coverage(pre_coverage, rows)
    )
