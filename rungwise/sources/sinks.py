"""Sinks: candidate and label tables, metrics, nested result documents and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.numeric import quantised
from rungwise.functions.times import utc_text
from rungwise.operators.ordered import side_by_side
from rungwise.operators.select import canonical_order
from rungwise.sources.tables import EVIDENCE_COLUMNS, SNAPSHOT_COLUMNS, TIME, VECTOR


def _as_text(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Serialise typed columns the way the closed-schema scans read them."""
    out: list[Column] = []
    kinds = dict(df.dtypes)
    for name, kind in columns.items():
        value = F.col(name)
        if kind == TIME and kinds[name] != "string":
            value = utc_text(value)
        elif kind == VECTOR and kinds[name] != "string":
            value = F.to_json(value)
        out.append(value.alias(name))
    return df.select(*out)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("compression", "gzip").option("escape", '"').mode(
        "error"
    ).csv(path)


def write_snapshot(rows: DataFrame, splits: Mapping[str, tuple[str, str]], path: str) -> None:
    """Candidate table in canonical order as gzip CSV parts, ordered by a range sort."""
    _write_csv(canonical_order(_as_text(rows, SNAPSHOT_COLUMNS), splits), path)


def write_evidence(rows: DataFrame, splits: Mapping[str, tuple[str, str]], path: str) -> None:
    """Verified-label table: whitelisted forecast and label columns, free text dropped."""
    _write_csv(canonical_order(_as_text(rows, EVIDENCE_COLUMNS), splits), path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Audit and decision tables (arrays of reasons included) as Parquet."""
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def metrics_table(metrics: DataFrame, split: str) -> DataFrame:
    """Published columns of the per-method scores of one split."""
    return metrics.where(F.col("split") == split).select(
        "horizon_seconds",
        "method",
        quantised("brier").alias("event_macro_brier"),
        quantised("log").alias("event_macro_log_loss"),
        F.col("edges").alias("monotonicity_violation_edges"),
        F.col("violating_events").alias("events_with_violations"),
    )


def write_metrics(metrics: DataFrame, split: str, path: str) -> None:
    table = metrics_table(metrics, split).orderBy(F.desc("horizon_seconds"), "method")
    table.write.option("header", True).mode("error").csv(path)


def result_document(
    summary: DataFrame, metrics: DataFrame, compared: DataFrame, gate: DataFrame
) -> DataFrame:
    """One JSON document from the long result tables (a few rows per split and horizon)."""
    keys = ["split", "horizon_seconds"]

    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        fields = [
            quantised(c).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
            if c not in (*keys, key)
        ]
        entry = F.struct(F.col(key), F.struct(*fields))
        return df.groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name)
        )

    cells = summary.join(packed(metrics, "method", "methods"), keys).join(
        packed(compared, "comparison", "comparisons"), keys, "left"
    )
    body = F.struct(*[c for c in cells.columns if c not in keys])
    by_horizon = F.map_from_entries(
        F.array_sort(
            F.collect_list(F.struct(F.col("horizon_seconds").cast("string"), F.to_json(body)))
        )
    )
    per_split = (
        cells.groupBy("split")
        .agg(F.to_json(by_horizon).alias("horizons"))
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "horizons")))).alias("s")
        )
    )
    conditions = gate.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "passed")))).alias("c"),
        F.every("passed").alias("all"),
    )
    return side_by_side(per_split, conditions).select(
        F.to_json(
            F.struct(
                F.col("s").alias("splits"),
                F.struct(F.col("c").alias("conditions"), F.col("all").alias("passed")).alias("gate"),
            )
        ).alias("value")
    )


def write_document(document: DataFrame, path: str) -> None:
    document.write.mode("error").text(path)
