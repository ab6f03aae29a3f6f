"""Point-in-time selection: newest point at or before a cutoff, with a staleness limit.

Points and cutoffs meet in one sorted union per (token, time bucket); what lies in earlier buckets
arrives as one carried summary per bucket. A token holding a large share of all points is thereby
spread over its time buckets, and no point is ever paired with more than its own sort neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
MICROS = 1_000_000

# Decision reasons.
NO_POINT = "no_point_at_or_before_cutoff"
STALE = "latest_point_exceeds_max_staleness"
CONFLICT = "conflicting_probabilities_at_one_timestamp"


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def distinct_points(points: DataFrame, bucket_seconds: int) -> DataFrame:
    """One row per (token, timestamp); copies collapse map-side and disagreement is kept."""
    when = micros("ts")
    return (
        points.where("token is not null and ts is not null")
        .groupBy("token", "ts")
        .agg(F.min("p").alias("p"), (F.min("p") != F.max("p")).alias("conflict"))
        .withColumn("at", when)
        .withColumn("bucket", F.floor(F.col("at") / (bucket_seconds * MICROS)))
    )


def latest_at_or_before(
    points: DataFrame, cutoffs: DataFrame, bucket_seconds: int = DAY_SECONDS
) -> DataFrame:
    """For each distinct ``(token, cutoff)``: newest earlier point, its age, earlier conflicts.

    ``points`` is ``token, ts, p``; ``cutoffs`` is ``token, cutoff``. The result has
    ``point_at`` (microseconds), ``p``, ``age_micros`` and ``conflict``, the latter true when any
    timestamp up to the cutoff carries two values. Choose ``bucket_seconds`` so that one token's
    distinct timestamps within a bucket fit a task; whole-second data has at most that many.
    """
    clean = distinct_points(points, bucket_seconds)
    asked = (
        cutoffs.where("token is not null and cutoff is not null")
        .select("token", F.col("cutoff").cast("timestamp").alias("cutoff"))
        .distinct()
        .withColumn("at", micros("cutoff"))
        .withColumn("bucket", F.floor(F.col("at") / (bucket_seconds * MICROS)))
    )
    rows = clean.select(
        "token", "bucket", "at", F.lit(0).alias("kind"),
        F.col("at").alias("point_at"), "p", "conflict",
        F.lit(None).cast("timestamp").alias("cutoff"),
    ).unionByName(
        asked.select(
            "token", "bucket", "at", F.lit(1).alias("kind"),
            F.lit(None).cast("bigint").alias("point_at"),
            F.lit(None).cast("double").alias("p"),
            F.lit(None).cast("boolean").alias("conflict"),
            "cutoff",
        )
    )
    so_far = (
        Window.partitionBy("token", "bucket")
        .orderBy("at", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = rows.select(
        "token", "bucket", "kind", "cutoff", "at",
        F.last("point_at", ignorenulls=True).over(so_far).alias("inside_at"),
        F.last("p", ignorenulls=True).over(so_far).alias("inside_p"),
        F.max("conflict").over(so_far).alias("inside_conflict"),
    ).where("kind = 1")

    # One row per (token, bucket): points seen there; a cutoff reads what came before its bucket.
    summary = rows.groupBy("token", "bucket").agg(
        F.max("point_at").alias("last_at"),
        F.max_by("p", "point_at").alias("last_p"),
        F.max("conflict").alias("any_conflict"),
    )
    earlier = (
        Window.partitionBy("token").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(
        "token", "bucket",
        F.last("last_at", ignorenulls=True).over(earlier).alias("carried_at"),
        F.last("last_p", ignorenulls=True).over(earlier).alias("carried_p"),
        F.max("any_conflict").over(earlier).alias("carried_conflict"),
    )
    no = F.lit(False)
    return (
        inside.join(carried, ["token", "bucket"], "left")
        .withColumn("point_at", F.coalesce("inside_at", "carried_at"))
        .select(
            "token",
            "cutoff",
            "point_at",
            F.coalesce("inside_p", "carried_p").alias("p"),
            (F.col("at") - F.col("point_at")).alias("age_micros"),
            (
                F.coalesce("inside_conflict", no) | F.coalesce("carried_conflict", no)
            ).alias("conflict"),
        )
    )


def reason(max_staleness_seconds: Column | int) -> Column:
    """Rejection reason, null for a usable point. A conflict outranks everything else."""
    limit = (
        max_staleness_seconds
        if isinstance(max_staleness_seconds, Column)
        else F.lit(max_staleness_seconds)
    )
    return (
        F.when(F.col("conflict"), CONFLICT)
        .when(F.col("point_at").isNull(), NO_POINT)
        .when(F.col("age_micros") > limit.cast("bigint") * MICROS, STALE)
    )


def asof_decisions(
    points: DataFrame,
    cutoffs: DataFrame,
    max_staleness_seconds: int,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Decision per distinct (token, cutoff): ``status``, ``reason`` and the usable point."""
    return decided(latest_at_or_before(points, cutoffs, bucket_seconds), max_staleness_seconds)


def decided(found: DataFrame, max_staleness_seconds: int) -> DataFrame:
    """Decisions from the newest earlier points (``latest_at_or_before``)."""
    if max_staleness_seconds < 0:
        raise ValueError("the staleness limit cannot be negative")
    why = found.withColumn("reason", reason(max_staleness_seconds))
    usable = F.col("reason").isNull()
    return why.select(
        "token",
        "cutoff",
        F.when(usable, "selected").otherwise("rejected").alias("status"),
        "reason",
        F.when(usable, F.col("p")).alias("p"),
        F.when(usable, F.timestamp_micros("point_at")).alias("point_ts"),
        F.when(usable, F.floor(F.col("age_micros") / MICROS)).alias("staleness_seconds"),
    )


def first_at_or_after(
    blocks: DataFrame, times: DataFrame, bucket_seconds: int = DAY_SECONDS
) -> DataFrame:
    """First block not earlier than each distinct ``at`` timestamp (null past the last block).

    The as-of selection on the mirrored time axis, with all blocks as one token.
    """
    def mirrored(ts: str) -> Column:
        return F.timestamp_micros(-micros(ts))

    points = blocks.groupBy("ts").agg(F.min("number").alias("number")).select(
        F.lit("chain").alias("token"), mirrored("ts").alias("ts"), F.col("number").cast("double").alias("p")
    )
    cutoffs = times.select(F.lit("chain").alias("token"), mirrored("at").alias("cutoff"))
    found = latest_at_or_before(points, cutoffs, bucket_seconds)
    return found.select(
        mirrored("cutoff").alias("at"),
        F.col("p").cast("bigint").alias("number"),
        F.timestamp_micros(-F.col("point_at")).alias("block_ts"),
    )


def expand_horizons(contracts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Each contract at each horizon, with its cutoff and UTC day (narrow, no shuffle)."""
    values = F.array(*[F.lit(int(h)).cast("bigint") for h in horizons])
    end = F.col("event_end")
    return contracts.withColumn("horizon_seconds", F.explode(values)).withColumns(
        {
            "cutoff": F.timestamp_micros(micros(end) - F.col("horizon_seconds") * MICROS),
            "utc_day": F.date_format(end, "yyyy-MM-dd"),
        }
    )


def cutoff_rows(
    contracts: DataFrame,
    points: DataFrame,
    horizons: Sequence[int],
    max_staleness_seconds: int,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """History decision for every contract x horizon."""
    wanted = expand_horizons(contracts, horizons)
    decided = asof_decisions(
        points, wanted.select("token", "cutoff"), max_staleness_seconds, bucket_seconds
    )
    return wanted.join(decided, ["token", "cutoff"])


def cutoff_rows_of_tokens(
    contracts: DataFrame,
    ends: DataFrame,
    points: DataFrame,
    horizons: Sequence[int],
    max_staleness_seconds: int,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """``cutoff_rows`` of contracts no two of which share a token; ``ends`` are their (token, event_end).

    A token has one cutoff per horizon, so its decisions are one bounded array: contracts, wide as
    they are, meet it by token, and their rows at each horizon are made after that.
    """
    wanted = expand_horizons(ends, horizons).select("token", "cutoff")
    found = F.struct("cutoff", "status", "reason", "p", "point_ts", "staleness_seconds")
    per_token = (
        asof_decisions(points, wanted, max_staleness_seconds, bucket_seconds)
        .groupBy("token").agg(F.collect_list(found).alias("found"))
    )
    rows = contracts.join(per_token, "token").select(*contracts.columns, F.inline("found"))
    end = F.col("event_end")
    age = F.floor((micros(end) - micros("cutoff")) / MICROS)
    return rows.withColumns({"horizon_seconds": age, "utc_day": F.date_format(end, "yyyy-MM-dd")})


def complete_curves(decisions: DataFrame, minimum: int) -> DataFrame:
    """Decision per (event, horizon): kept only if every strict contract has a fresh point."""
    fresh = F.count(F.when(F.col("status") == "selected", 1))
    total = F.count(F.lit(1))
    per_curve = decisions.groupBy("event_id", "horizon_seconds").agg(
        fresh.alias("eligible_history_contract_count"),
        total.alias("strict_market_contract_count"),
    )
    accepted = (
        F.col("eligible_history_contract_count") == F.col("strict_market_contract_count")
    ) & (F.col("strict_market_contract_count") >= minimum)
    return per_curve.withColumn(
        "status", F.when(accepted, "selected").otherwise("rejected")
    ).withColumn("reason", F.when(~accepted, "incomplete_fresh_curve"))


def retained_rows(decisions: DataFrame, curves: DataFrame) -> DataFrame:
    """Rows of the accepted curves, stamped with the ladder size."""
    kept = curves.where(F.col("status") == "selected").select(
        "event_id",
        "horizon_seconds",
        F.col("eligible_history_contract_count").alias("event_horizon_contract_count"),
    )
    return decisions.join(kept, ["event_id", "horizon_seconds"])


def staleness_sensitivity(
    contracts: DataFrame,
    points: DataFrame,
    horizons: Sequence[int],
    tolerances: Sequence[int],
    minimum: int,
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Retained events and rows per horizon under each tolerance, from one as-of pass.

    Freshness under every tolerance is counted per curve in one aggregate, so the rows are not
    multiplied by the number of tolerances.
    """
    wanted = expand_horizons(contracts, horizons)
    found = latest_at_or_before(points, wanted.select("token", "cutoff"), bucket_seconds)
    aged = wanted.join(found, ["token", "cutoff"])
    counts = [
        F.count(F.when(reason(tol).isNull(), 1)).alias(f"fresh_{tol}") for tol in tolerances
    ]
    curves = aged.groupBy("event_id", "horizon_seconds").agg(
        F.count(F.lit(1)).alias("total"), *counts
    )
    per_tolerance = F.array(
        *[
            F.struct(
                F.lit(int(tol)).cast("bigint").alias("tolerance_seconds"),
                F.col(f"fresh_{tol}").alias("fresh"),
            )
            for tol in tolerances
        ]
    )
    long = curves.select("event_id", "horizon_seconds", "total", F.inline(per_tolerance))
    kept = (F.col("fresh") == F.col("total")) & (F.col("total") >= minimum)
    return long.groupBy("horizon_seconds", "tolerance_seconds").agg(
        F.count(F.lit(1)).alias("expected_events"),
        F.sum("total").alias("expected_rows"),
        F.count(F.when(kept, 1)).alias("retained_events"),
        F.coalesce(F.sum(F.when(kept, F.col("total"))), F.lit(0)).alias("retained_rows"),
    )
