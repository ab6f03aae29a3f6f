"""Coverage per split and horizon, completeness of the grid, and reconciliation of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.numeric import ratio_matches, safe_ratio
from rungwise.operators.ordered import side_by_side

CELL = ["split", "horizon_seconds"]
# Resolution statuses.
STATUSES = ("agreed", "missing", "ambiguous", "gamma_disagreement")


def cell_counts(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows and events per cell; events are pre-aggregated so no cell is one task's work."""
    events = rows.groupBy(*CELL, "event_id").agg(F.count(F.lit(1)).alias("n"))
    return events.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias(f"{prefix}_events"), F.sum("n").alias(f"{prefix}_rows")
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def history_coverage(grid: DataFrame, events: DataFrame, retained: DataFrame) -> DataFrame:
    """Retained against expected, per declared cell.

    ``events`` lists the selected events with ``split`` and ``eligible_market_count``.
    """
    expected = events.groupBy("split").agg(
        F.count(F.lit(1)).alias("expected_events"),
        F.sum("eligible_market_count").alias("expected_rows"),
    )
    table = (
        F.broadcast(grid)
        .join(expected, "split", "left")
        .join(cell_counts(retained, "history_retained"), CELL, "left")
    )
    names = ("expected_events", "expected_rows", "history_retained_events", "history_retained_rows")
    return table.select(*CELL, *[_zero(n) for n in names]).withColumns(
        {
            "event_history_coverage": safe_ratio("history_retained_events", "expected_events"),
            "row_history_coverage": safe_ratio("history_retained_rows", "expected_rows"),
        }
    )


def complete_agreed_events(rows: DataFrame) -> DataFrame:
    """Events, per cell, all of whose rows carry the status ``agreed``."""
    agreed = F.min((F.col("status") == "agreed").cast("int")) == 1
    return (
        rows.groupBy(*CELL, "event_id")
        .agg(agreed.alias("complete"))
        .where("complete")
        .select(*CELL, "event_id")
    )


def label_coverage(pre: DataFrame, rows: DataFrame) -> DataFrame:
    """Add what the complete-event label gate keeps to the history coverage ``pre``."""
    per_event = rows.groupBy(*CELL, "event_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min((F.col("status") == "agreed").cast("int")) == 1).alias("complete"),
    )
    kept = per_event.where("complete").groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("retained_events"), F.sum("n").alias("retained_rows")
    )
    joined = pre.join(kept, CELL, "left").select(
        *pre.columns, _zero("retained_events"), _zero("retained_rows")
    )
    return joined.withColumns(
        {
            "event_coverage": safe_ratio("retained_events", "expected_events"),
            "row_coverage": safe_ratio("retained_rows", "expected_rows"),
            "event_chain_given_history_coverage": safe_ratio(
                "retained_events", "history_retained_events"
            ),
            "row_chain_given_history_coverage": safe_ratio(
                "retained_rows", "history_retained_rows"
            ),
        }
    )


def status_counts(df: DataFrame) -> DataFrame:
    """Rows per status over the closed vocabulary, zeros kept."""
    vocabulary = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(vocabulary).join(counted, "status", "left").select("status", _zero("n"))


def status_algebra(conditions: DataFrame, rows: DataFrame, retained_rows: DataFrame) -> DataFrame:
    """One row: counts per status and whether the sums and orderings between them hold."""

    def counts(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{prefix}_total"),
            *[
                F.count(F.when(F.col("status") == s, 1)).alias(f"{prefix}_{s}")
                for s in STATUSES
            ],
        )

    kept = retained_rows.agg(F.count(F.lit(1)).alias("retained_rows"))
    table = side_by_side(counts(conditions, "conditions"), counts(rows, "rows"), kept)

    def total(prefix: str) -> Column:
        return sum((F.col(f"{prefix}_{s}") for s in STATUSES), F.lit(0))

    return table.withColumns(
        {
            "conditions_sum_ok": total("conditions") == F.col("conditions_total"),
            "rows_sum_ok": total("rows") == F.col("rows_total"),
            "retained_within_agreed": F.col("retained_rows") <= F.col("rows_agreed"),
            "all_verified": F.col("conditions_agreed") == F.col("conditions_total"),
        }
    )


def missing_cells(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Cells on one side only, both directions."""
    seen = observed.select(*CELL).distinct()
    absent = declared.join(seen, CELL, "left_anti").withColumn("problem", F.lit("missing"))
    extra = seen.join(F.broadcast(declared), CELL, "left_anti").withColumn(
        "problem", F.lit("undeclared")
    )
    return absent.unionByName(extra)


def undeclared_values(df: DataFrame, column: str, declared: Sequence) -> DataFrame:
    """Values outside a declared vocabulary, with their row counts."""
    return (
        df.where(~F.col(column).isin(*declared))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


NESTED = (
    ("retained_events", "history_retained_events"),
    ("history_retained_events", "expected_events"),
    ("retained_rows", "history_retained_rows"),
    ("history_retained_rows", "expected_rows"),
)
COUNTS = (
    "expected_events",
    "retained_events",
    "expected_rows",
    "retained_rows",
    "history_retained_events",
    "history_retained_rows",
)
RATIOS = (
    ("event_coverage", "retained_events", "expected_events"),
    ("row_coverage", "retained_rows", "expected_rows"),
    ("event_history_coverage", "history_retained_events", "expected_events"),
    ("row_history_coverage", "history_retained_rows", "expected_rows"),
    ("event_chain_given_history_coverage", "retained_events", "history_retained_events"),
    ("row_chain_given_history_coverage", "retained_rows", "history_retained_rows"),
)


def reconcile(declared: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Violations between declared and recomputed coverage, cell by cell.

    Both sides are keyed by split and horizon; only fields present on both sides are compared.
    """
    shared = [c for c in declared.columns if c in recomputed.columns and c not in CELL]
    d, r = declared.alias("d"), recomputed.alias("r")
    joined = d.join(r, CELL, "full_outer").select(
        *CELL,
        F.col(f"d.{shared[0]}").isNotNull().alias("is_declared"),
        F.col(f"r.{shared[0]}").isNotNull().alias("is_found"),
        *[F.col(f"d.{c}").alias(f"d_{c}") for c in shared],
        *[F.col(f"r.{c}").alias(f"r_{c}") for c in shared],
    )
    both = F.col("is_declared") & F.col("is_found")
    rules = [
        ("cell_not_declared", ~F.col("is_declared")),
        ("cell_not_found", ~F.col("is_found")),
    ]
    for name in COUNTS:
        if name in shared:
            rules.append((f"count_{name}", both & ~F.col(f"d_{name}").eqNullSafe(F.col(f"r_{name}"))))
    for part, whole in NESTED:
        if part in shared and whole in shared:
            rules.append((f"nested_{part}", both & (F.col(f"d_{part}") > F.col(f"d_{whole}"))))
    for name, part, whole in RATIOS:
        if {name, part, whole} <= set(shared):
            rules.append(
                (f"ratio_{name}", both & ~ratio_matches(f"d_{name}", f"d_{part}", f"d_{whole}"))
            )
    fired = F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))
    return joined.select(*CELL, F.explode(fired).alias("rule"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Row, curve and selected-event totals; expected events must agree across horizons."""
    expected = F.when(
        F.min("expected_events") == F.max("expected_events"), F.min("expected_events")
    ).otherwise(F.raise_error(F.lit("expected events disagree across horizons")))
    per_split = coverage.groupBy("split").agg(
        expected.alias("events"),
        F.sum("history_retained_events").alias("curves"),
        F.sum("history_retained_rows").alias("rows"),
    )
    return per_split.agg(
        F.sum("rows").alias("candidate_rows"),
        F.sum("curves").alias("candidate_curves"),
        F.sum("events").alias("selected_events"),
    )


def nested_document(coverage: DataFrame) -> DataFrame:
    """One JSON document split -> horizon -> metrics, from the flat (split x horizon) table."""
    metrics = F.struct(*sorted(c for c in coverage.columns if c not in CELL))
    entry = F.struct(F.col("horizon_seconds").cast("string"), metrics)
    per_split = coverage.groupBy("split").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("horizons")
    )
    splits = F.array_sort(F.collect_list(F.struct("split", F.to_json("horizons").alias("j"))))
    body = F.transform(splits, lambda s: F.concat(F.lit('"'), s["split"], F.lit('":'), s["j"]))
    return per_split.agg(
        F.concat(F.lit("{"), F.concat_ws(",", body), F.lit("}")).alias("document")
    )
