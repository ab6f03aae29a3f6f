"""Closed-schema CSV scans and the candidate loader with column aliases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.functions.chain import hex_bytes
from rungwise.functions.documents import agreed_label
from rungwise.functions.times import utc_timestamp, zoned_timestamp

TIME, TEXT, LOWER, LONG, REAL, VECTOR = "time", "text", "lower", "bigint", "double", "vector"

# The closed schemas, in file order.
FORECAST_COLUMNS = {
    "event_id": TEXT,
    "market_id": TEXT,
    "condition_id": LOWER,
    "asset": TEXT,
    "scheduled_time": TIME,
    "utc_day": TEXT,
    "split": TEXT,
    "horizon_seconds": LONG,
    "cutoff_time": TIME,
    "threshold": REAL,
    "gamma_candidate_label": TEXT,
    "yes_token": TEXT,
    "reference_probability": REAL,
    "reference_timestamp": TIME,
    "staleness_seconds": LONG,
    "source_event_sha256": TEXT,
    "source_history_sha256": TEXT,
}
SNAPSHOT_COLUMNS = FORECAST_COLUMNS | {
    "event_title": TEXT,
    "question": TEXT,
    "no_token": TEXT,
    "event_horizon_contract_count": LONG,
    "gamma_candidate_label_source": TEXT,
    "gamma_candidate_label_onchain_verified": TEXT,
}
EVIDENCE_COLUMNS = FORECAST_COLUMNS | {
    "event_horizon_contract_count": LONG,
    "label": REAL,
    "payout_vector": VECTOR,
    "resolution_block_number": LONG,
    "resolution_block_hash": LOWER,
    "resolution_block_timestamp": TIME,
    "resolution_tx_hash": LOWER,
    "resolution_log_index": LONG,
    "chain_source_sha256": TEXT,
}
# Accepted names of the candidate fields.
TARGET_ALIASES = (
    "target_timestamp",
    "target_time",
    "scheduled_at",
    "scheduled_time",
    "scheduled_timestamp",
    "event_timestamp",
    "end_date",
    "endDate",
)
CANDIDATE_ALIASES = {
    "event_id": ("event_id", "eventId"),
    "condition_id": ("condition_id", "conditionId"),
    "target": TARGET_ALIASES,
    "split": ("split",),
    "horizon": ("horizon_seconds", "forecast_horizon_seconds", "horizon"),
    "outcomes": ("outcomes", "outcome_order"),
    "explicit": (
        "gamma_candidate_yes_probability",
        "gamma_candidate_yes",
        "candidate_yes_probability",
        "gamma_candidate_label",
    ),
    "prices": ("outcome_prices", "outcomePrices"),
}
REQUIRED_CANDIDATE = ("event_id", "condition_id", "target", "split", "horizon")


class SchemaError(ValueError):
    """A table does not have exactly the declared columns."""


def _typed(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == TIME:
        return utc_timestamp(value)
    if kind == LOWER:
        return F.lower(value)
    if kind == VECTOR:
        return F.from_json(value, "array<int>")
    return value if kind == TEXT else value.try_cast(kind)


def typed_table(raw: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Cast text columns to a closed schema; a cell that cannot be cast becomes null.

    Null cells are reported by the row rules of ``quality``.
    """
    missing = sorted(set(columns) - set(raw.columns))
    if missing:
        raise SchemaError(f"table is missing columns: {missing}")
    unexpected = sorted(set(raw.columns) - set(columns))
    if unexpected:
        raise SchemaError(f"table has unexpected columns: {unexpected}")
    return raw.select(*[_typed(name, kind).alias(name) for name, kind in columns.items()])


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by header; gzip is recognised by its suffix."""
    return spark.read.option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).option("nullValue", "\u0000").csv(path)


def scan_evidence(spark: SparkSession, path: str) -> DataFrame:
    return typed_table(scan_csv(spark, path), EVIDENCE_COLUMNS)


def scan_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot rows; the numeric candidate label becomes ``label``."""
    typed = typed_table(scan_csv(spark, path), SNAPSHOT_COLUMNS)
    return typed.withColumn("label", F.col("gamma_candidate_label").try_cast("double"))


def alias_value(df: DataFrame, aliases: Sequence[str]) -> tuple[Column, Column]:
    """First non-blank alias as text, and whether two non-blank aliases disagree."""
    present = [F.col(a).cast("string") for a in aliases if a in df.columns]
    if not present:
        return F.lit(None).cast("string"), F.lit(False)
    filled = F.filter(F.array(*present), lambda v: v.isNotNull() & (v != ""))
    return F.try_element_at(filled, F.lit(1)), F.size(F.array_distinct(filled)) > 1


def normalise_candidates(
    raw: DataFrame, outcomes: Sequence[str] = ("Yes", "No"), keep: Sequence[str] = ()
) -> DataFrame:
    """Candidate rows under their canonical names, with the problems of each row.

    ``problems`` is empty for a usable row. Columns named in ``keep`` come first, as they are.
    """
    values, problems = {}, []
    for name, aliases in CANDIDATE_ALIASES.items():
        value, conflict = alias_value(raw, aliases)
        values[name] = value
        problems.append((f"conflicting_{name}", conflict))
        if name in REQUIRED_CANDIDATE:
            problems.append((f"missing_{name}", value.isNull() | (F.trim(value) == "")))
    condition = hex_bytes(values["condition_id"], 32)
    target = zoned_timestamp(values["target"])
    label = agreed_label(values["explicit"], values["prices"])
    wanted = F.array(*[F.lit(o) for o in outcomes])
    given = F.from_json(values["outcomes"], "array<string>")
    problems += [
        ("bad_condition_id", values["condition_id"].isNotNull() & condition.isNull()),
        ("bad_target", values["target"].isNotNull() & target.isNull()),
        ("bad_outcome_order", values["outcomes"].isNotNull() & ~given.eqNullSafe(wanted)),
        ("no_consistent_candidate", label.isNull()),
    ]
    return raw.select(
        *keep,
        F.trim(values["event_id"]).alias("event_id"),
        condition.alias("condition_id"),
        target.alias("target_at"),
        F.trim(values["split"]).alias("split"),
        F.trim(values["horizon"]).alias("horizon"),
        label.alias("candidate"),
        F.array_compact(F.array(*[F.when(test, name) for name, test in problems])).alias("problems"),
    )


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows from flat CSV, or from JSON rows / nested events."""
    from rungwise.sources.nested import flatten_candidates

    if ".csv" in path:
        return normalise_candidates(scan_csv(spark, path))
    return normalise_candidates(
        flatten_candidates(spark.read.option("multiLine", True).json(path))
    )
