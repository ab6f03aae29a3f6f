"""Score a snapshot: calibrate, project, score every slice, bootstrap the holdout, apply the gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.config import Protocol
from rungwise.operators import bootstrap as bst
from rungwise.functions.numeric import is_finite
from rungwise.operators import scoring
from rungwise.operators.calibrate import Model, apply_calibrators, fit_calibrators, model_table
from rungwise.operators.isotonic import project_ladders
from rungwise.operators.ordered import MAX_GROUP_ROWS, side_by_side
from rungwise.operators.quality import DataQualityError
from rungwise.session import written

SLICE = ["split", "horizon_seconds"]
LADDER = ["event_id", "horizon_seconds"]
METHODS = {
    "raw": "p",
    "pav_raw": "pav_raw",
    "platt": "p_platt",
    "beta": "p_beta",
    "pav_beta": "pav_beta",
}


@dataclass
class Evaluation:
    """Result tables of one run, each planned when it is first asked for.

    Predictions and event losses are written in the shared folder, so every table starts there; the
    bootstrap runs only if intervals or the gate are read.
    """

    models: list[Model]
    predictions: DataFrame
    events: DataFrame
    protocol: Protocol
    coverage: DataFrame
    max_rows: int = MAX_GROUP_ROWS

    def model_table(self) -> DataFrame:
        return model_table(self.predictions.sparkSession, self.models)

    @cached_property
    def summary(self) -> DataFrame:
        return scoring.slice_summary(self.predictions, SLICE)

    @cached_property
    def metrics(self) -> DataFrame:
        return method_table(self.predictions, self.events, max_rows=self.max_rows)

    @cached_property
    def comparisons(self) -> DataFrame:
        return scoring.comparisons(scoring.macro_scores(self.events, SLICE, METHODS), SLICE)

    @cached_property
    def subgroups(self) -> DataFrame:
        return scoring.asset_subgroups(self.events, SLICE)

    @cached_property
    def intervals(self) -> DataFrame:
        return comparison_intervals(self.events, self.protocol, self.max_rows)

    def reporting_gate(self, verified: DataFrame | None = None) -> DataFrame:
        """The gate's conditions, with ``verified`` labels two more. Of intervals and methods, only those
        they read are made."""
        intervals = comparison_intervals(
            self.events, self.protocol, self.max_rows, ("brier",), [self.protocol.primary_horizon]
        )
        metrics = method_table(
            self.predictions, self.events, methods={"pav_raw": METHODS["pav_raw"]}, max_rows=self.max_rows
        )
        return reporting_gate(
            self.protocol, self.summary, self.comparisons, self.subgroups, metrics,
            intervals, self.coverage, verified,
        )

    @cached_property
    def gate(self) -> DataFrame:
        return self.reporting_gate()


def predict(rows: DataFrame, protocol: Protocol, max_rows: int = MAX_GROUP_ROWS):
    """Fit on the training split and add the five method columns.

    ``rows``: ``event_id, horizon_seconds, threshold, p, label, split, block, asset``.
    """
    training = rows.where(F.col("split") == protocol.training_split)
    models = fit_calibrators(training, protocol.horizons, settings=protocol.calibration)
    projected = project_ladders(
        rows, LADDER, "threshold", {"p": "pav_raw", "p_beta": "pav_beta"}, max_rows=max_rows,
        derive=lambda moved: apply_calibrators(moved, models, protocol.calibration.epsilon),
    )
    return models, projected


def method_table(
    predictions: DataFrame,
    events: DataFrame,
    slice_keys: Sequence[str] = SLICE,
    methods: dict[str, str] = METHODS,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Scores and violations per slice and method."""
    keys = list(slice_keys)
    scores = scoring.macro_scores(events, keys, methods)
    rising = scoring.violations(predictions, LADDER, keys, "threshold", methods, max_rows)
    wide = scores.join(rising, keys)
    return scoring.per_method(wide, keys, methods, "brier", "log", "edges", "violating_events")


def comparison_intervals(
    events: DataFrame,
    protocol: Protocol,
    max_rows: int,
    losses: Sequence[str] = ("brier", "log"),
    horizons: Sequence[int] | None = None,
) -> DataFrame:
    """Bootstrap intervals of all comparisons on the holdout, per horizon and loss.

    The four comparisons of a loss share their draws; the log loss uses the next seed. Horizons are
    resampled each by itself, so only some ``horizons`` or ``losses`` have the intervals that all have.
    The inputs are checked whole.
    """
    bst.check_settings(protocol.resamples, protocol.confidence, protocol.seed)
    held = events.where(
        (F.col("split") == protocol.holdout_split)
        & F.col("horizon_seconds").isin([int(h) for h in protocol.horizons])
    )
    bst.check_inputs(held, [f"{m}__{loss}" for m in METHODS for loss in ("brier", "log")])
    if horizons is not None:
        held = held.where(F.col("horizon_seconds").isin([int(h) for h in horizons]))
    found = []
    for loss in losses:
        seed = protocol.seed + (loss == "log")
        diffs = {
            name: F.col(f"{base}__{loss}") - F.col(f"{model}__{loss}")
            for name, base, model in scoring.COMPARISONS
        }
        paired = held.select("horizon_seconds", "event_id", "block", *[d.alias(n) for n, d in diffs.items()])
        replicates = bst.replicates(
            paired, list(diffs), protocol.resamples, [seed], ["horizon_seconds"], max_rows
        )
        bounds = bst.intervals(replicates, list(diffs), protocol.confidence, ["horizon_seconds"])
        found.append(bounds.withColumn("loss", F.lit(loss)))
    return reduce(DataFrame.unionByName, found).select(
        F.lit(protocol.holdout_split).alias("split"),
        "horizon_seconds",
        F.col("name").alias("comparison"),
        "loss",
        "lower",
        "upper",
    )


def reporting_gate(
    protocol: Protocol,
    summary: DataFrame,
    comparisons: DataFrame,
    subgroups: DataFrame,
    metrics: DataFrame,
    intervals: DataFrame,
    coverage: DataFrame,
    verified: DataFrame | None = None,
) -> DataFrame:
    """Named conditions of the claim on the primary holdout slice, one row each.

    ``verified`` adds the two label conditions: one row with ``all_verified`` and
    ``disagreements``.
    """
    limits = protocol.gate

    def primary(df: DataFrame) -> DataFrame:
        return df.where(
            (F.col("split") == protocol.holdout_split)
            & (F.col("horizon_seconds") == protocol.primary_horizon)
        )

    main = primary(comparisons).where("comparison = 'pav_raw_vs_raw'")
    extra = primary(comparisons).where("comparison = 'pav_beta_vs_beta'")
    bounds = primary(intervals).where("loss = 'brier'").agg(
        F.max(F.when(F.col("comparison") == "pav_raw_vs_raw", F.col("lower"))).alias("lower"),
        F.max(F.when(F.col("comparison") == "pav_beta_vs_beta", F.col("lower"))).alias("extra_lower"),
    )
    assets = F.array(*[F.lit(a) for a in sorted(protocol.assets)])
    groups = primary(subgroups).agg(
        F.array_sort(F.collect_set("asset")).eqNullSafe(assets).cast("double").alias("all_assets"),
        F.min("brier_delta").alias("worst_asset"),
    )
    parts = [
        primary(summary).select("events", "blocks"),
        primary(coverage).select("event_coverage", "row_coverage"),
        main.select("relative_brier_improvement", "log_loss_delta"),
        extra.select(F.col("relative_brier_improvement").alias("extra_relative")),
        bounds,
        groups,
        primary(metrics).where("method = 'pav_raw'").select("edges"),
    ]

    def row(gate: str, name: str, value, limit: float, passed) -> object:
        return F.struct(
            F.lit(gate).alias("gate"),
            F.lit(name).alias("condition"),
            value.cast("double").alias("value"),
            F.lit(float(limit)).alias("limit"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    c = F.col
    rows = [
        row("primary", "minimum_holdout_events", c("events"), limits.minimum_events,
            c("events") >= limits.minimum_events),
        row("primary", "minimum_holdout_utc_days", c("blocks"), limits.minimum_blocks,
            c("blocks") >= limits.minimum_blocks),
        row("primary", "minimum_event_coverage", c("event_coverage"),
            limits.minimum_event_coverage,
            c("event_coverage") >= limits.minimum_event_coverage),
        row("primary", "minimum_contract_coverage", c("row_coverage"),
            limits.minimum_row_coverage, c("row_coverage") >= limits.minimum_row_coverage),
        row("primary", "minimum_relative_brier_improvement", c("relative_brier_improvement"),
            limits.minimum_relative_improvement,
            c("relative_brier_improvement") >= limits.minimum_relative_improvement),
        row("primary", "brier_ci_lower_above_zero", c("lower"), 0.0, c("lower") > 0.0),
        row("primary", "log_loss_regression_within_limit", c("log_loss_delta"),
            -limits.maximum_log_regression,
            c("log_loss_delta") >= -limits.maximum_log_regression),
        row("primary", "nonnegative_asset_subgroups", c("worst_asset"), 0.0,
            (c("all_assets") == 1.0) & (c("worst_asset") >= scoring.SUBGROUP_TOLERANCE)),
        row("primary", "all_projection_violations_removed", c("edges"), 0.0, c("edges") == 0),
        row("incremental", "minimum_relative_brier_improvement", c("extra_relative"),
            limits.minimum_relative_improvement,
            c("extra_relative") >= limits.minimum_relative_improvement),
        row("incremental", "brier_ci_lower_above_zero", c("extra_lower"), 0.0,
            c("extra_lower") > 0.0),
    ]
    if verified is not None:
        parts.append(verified.select("all_verified", "disagreements"))
        rows += [
            row("primary", "canonical_chain_labels_verified", c("all_verified"), 1.0,
                c("all_verified")),
            row("primary", "gamma_candidate_mismatches_zero", c("disagreements"), 0.0,
                c("disagreements") == 0),
        ]
    return side_by_side(*parts).select(F.inline(F.array(*rows)))


def input_problems(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """Violations (rule_id, key, detail) of the table to be evaluated; empty if it may be.

    Per row: probability, label, threshold, split and horizon; per rung: repeated thresholds; per
    event: one split, block and asset; per declared slice: at least one row.
    """
    p, y, t = F.col("p"), F.col("label"), F.col("threshold")
    broken = {
        "probability_not_in_unit_interval": p.isNull() | F.isnan(p) | (p < 0) | (p > 1),
        "label_not_binary": y.isNull() | ~((y == 0) | (y == 1)),
        "threshold_not_finite": ~is_finite("threshold"),
        "split_not_declared": ~F.coalesce(F.col("split").isin(list(protocol.splits)), F.lit(False)),
        "horizon_not_declared": ~F.coalesce(
            F.col("horizon_seconds").isin([int(h) for h in protocol.horizons]), F.lit(False)
        ),
        "event_missing": F.col("event_id").isNull() | F.col("block").isNull(),
    }
    fired = F.array_compact(F.array(*[F.when(test, name) for name, test in broken.items()]))
    event = F.coalesce(F.col("event_id").cast("string"), F.lit(""))
    per_row = rows.select(event.alias("key"), F.explode(fired).alias("rule_id"))
    rungs = rows.groupBy(event.alias("key"), "horizon_seconds", t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    repeated = rungs.where("n > 1").select("key", F.lit("threshold_repeated").alias("rule_id"))
    facts = [F.min(c).alias(f"{c}_lo") for c in ("split", "block", "asset")]
    facts += [F.max(c).alias(f"{c}_hi") for c in ("split", "block", "asset")]
    per_event = rows.groupBy(event.alias("key")).agg(*facts)
    several = F.array_compact(
        F.array(*[F.when(F.col(f"{c}_lo") != F.col(f"{c}_hi"), f"event_in_several_{c}s") for c in ("split", "block", "asset")])
    )
    spread = per_event.select("key", F.explode(several).alias("rule_id"))
    found = per_row.unionByName(repeated).unionByName(spread).groupBy("rule_id", "key").agg(F.count(F.lit(1)).alias("n"))
    listed = found.select("rule_id", "key", F.concat(F.col("n").cast("string"), F.lit(" times")).alias("detail"))
    grid = protocol.grid(rows.sparkSession)
    cells = rows.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n"))
    empty = grid.join(cells, SLICE, "left_anti").select(
        F.lit("slice_empty").alias("rule_id"),
        F.concat_ws("/", "split", F.col("horizon_seconds").cast("string")).alias("key"),
        F.lit("no rows").alias("detail"),
    )
    return listed.unionByName(empty)


def check_input(rows: DataFrame, protocol: Protocol) -> None:
    """Raise, naming some of what is wrong, unless the table may be evaluated."""
    some = input_problems(rows, protocol).orderBy("rule_id", "key").limit(5).collect()
    if some:
        raise DataQualityError("; ".join(f"{r.rule_id} {r.key} ({r.detail})" for r in some))


def evaluate(
    rows: DataFrame, protocol: Protocol, coverage: DataFrame, max_rows: int = MAX_GROUP_ROWS
) -> Evaluation:
    """Full run over all splits and horizons. ``coverage`` holds the declared slice coverage.

    The table is written once to the shared folder, checked, and only then fitted and scored.
    """
    rows = written(
        rows.select("event_id", "horizon_seconds", "threshold", "p", "label", "split", "block", "asset"), "ladders"
    )
    check_input(rows, protocol)
    models, projected = predict(rows, protocol, max_rows)
    predictions = written(projected, "predictions")
    events = written(
        scoring.event_losses(
            predictions, [*SLICE, "event_id", "asset", "block"], METHODS, protocol.log_epsilon
        ),
        "event-losses",
    )
    return Evaluation(models, predictions, events, protocol, coverage, max_rows)
