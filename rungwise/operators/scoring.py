"""Event-macro scores, monotonicity violations and method comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.numeric import RISE_TOLERANCE, brier_loss, log_loss
from rungwise.operators.ordered import MAX_GROUP_ROWS, segment, with_next

# The reported (comparison, baseline method, model method) pairs.
COMPARISONS = (
    ("pav_raw_vs_raw", "raw", "pav_raw"),
    ("beta_vs_raw", "raw", "beta"),
    ("pav_beta_vs_beta", "beta", "pav_beta"),
    ("pav_beta_vs_raw", "raw", "pav_beta"),
)
SUBGROUP_TOLERANCE = -1e-15


def event_losses(
    df: DataFrame, keys: list[str], methods: Mapping[str, str], epsilon: float = 1e-6
) -> DataFrame:
    """Mean Brier and log loss per event for every ``method -> probability column``.

    One partial aggregation serves all methods, so a large event shrinks before the shuffle.
    """
    losses: list[Column] = []
    for method, p in methods.items():
        losses.append(F.avg(brier_loss(p, "label")).alias(f"{method}__brier"))
        losses.append(F.avg(log_loss(p, "label", epsilon)).alias(f"{method}__log"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *losses)


def macro_scores(events: DataFrame, slice_keys: list[str], methods: Iterable[str]) -> DataFrame:
    """Average event losses with equal weight per event: one wide row per slice."""
    averages = [
        F.avg(f"{method}__{loss}").alias(f"{method}__{loss}")
        for method in methods
        for loss in ("brier", "log")
    ]
    return events.groupBy(*slice_keys).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("events"), *averages
    )


def per_method(wide: DataFrame, keys: list[str], methods: Iterable[str], *fields: str) -> DataFrame:
    """Unfold ``method__field`` columns into one row per method."""
    rows = F.array(
        *[
            F.struct(
                F.lit(method).alias("method"),
                *[F.col(f"{method}__{field}").alias(field) for field in fields],
            )
            for method in methods
        ]
    )
    return wide.select(*keys, F.inline(rows))


def ladder_edges(
    df: DataFrame,
    keys: list[str],
    order: str,
    p: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adjacent differences along each ladder."""
    paired = with_next(segment(df, keys, order, max_rows), p, "next_p")
    return paired.where("next_p is not null").withColumn("step", F.col("next_p") - F.col(p))


def violations(
    df: DataFrame,
    keys: list[str],
    slice_keys: list[str],
    order: str,
    methods: Mapping[str, str],
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rising edges and events having one, per slice and method.

    All methods travel in one struct so that a single sort of the ladders serves them.
    """
    needed = list(dict.fromkeys([*slice_keys, *keys, order, *methods.values()]))
    packed = df.select(*needed).withColumn("_now", F.struct(*methods.values()))
    paired = with_next(segment(packed, keys, order, max_rows), "_now", "_next")
    rising = {
        method: (F.col(f"_next.{p}") - F.col(p) > RISE_TOLERANCE).cast("bigint")
        for method, p in methods.items()
    }
    event_keys = list(dict.fromkeys([*slice_keys, *keys]))
    per_event = paired.groupBy(*event_keys).agg(
        *[F.coalesce(F.sum(flag), F.lit(0)).alias(method) for method, flag in rising.items()]
    )
    return per_event.groupBy(*slice_keys).agg(
        *[F.sum(method).alias(f"{method}__edges") for method in methods],
        *[F.count(F.when(F.col(m) > 0, 1)).alias(f"{m}__violating_events") for m in methods],
    )


def slice_summary(df: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Rows, events and blocks per slice, from one pre-aggregated table of events."""
    events = df.groupBy(*slice_keys, "event_id", "block").agg(F.count(F.lit(1)).alias("rows"))
    return events.groupBy(*slice_keys).agg(
        F.sum("rows").alias("rows"),
        F.countDistinct("event_id").alias("events"),
        F.countDistinct("block").alias("blocks"),
    )


def comparisons(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Score differences of the fixed method pairs; a baseline Brier of zero is an error."""
    rows = []
    for name, baseline, model in COMPARISONS:
        base, other = F.col(f"{baseline}__brier"), F.col(f"{model}__brier")
        positive = F.when(base > 0, base).otherwise(
            F.raise_error(F.lit(f"the Brier score of {baseline} is 0: nothing to improve on"))
        )
        rows.append(
            F.struct(
                F.lit(name).alias("comparison"),
                F.lit(baseline).alias("baseline"),
                F.lit(model).alias("model"),
                (base - other).alias("brier_delta"),
                ((base - other) / positive).alias("relative_brier_improvement"),
                (F.col(f"{baseline}__log") - F.col(f"{model}__log")).alias("log_loss_delta"),
            )
        )
    return scores.select(*keys, F.inline(F.array(*rows)))


def asset_subgroups(events: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Brier improvement of the projection per asset."""
    return events.groupBy(*slice_keys, "asset").agg(
        F.count(F.lit(1)).alias("events"),
        (F.avg("raw__brier") - F.avg("pav_raw__brier")).alias("brier_delta"),
    )
