"""Projection, scores, calibration, bootstrap and the full evaluation over the ladder view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.functions.numeric import quantised
from rungwise.operators import bootstrap as bst
from rungwise.operators import coverage
from rungwise.operators import calibrate, scoring
from rungwise.operators.isotonic import project_ladders
from rungwise.operators.ordered import percentiles as ordered_percentiles
from rungwise.operators.ordered import segment, with_index
from rungwise.plans import evaluate as ev
from rungwise.sources import sinks
from rungwise.workload import sql, views

LADDER = ev.LADDER
SLICE = ev.SLICE
RAW_METHODS = {"raw": "p", "pav_raw": "pav_raw"}
DECIMALS = 9


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    return df.select(
        *[
            (F.round(c, decimals) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def projected(spark: SparkSession, folder: str) -> DataFrame:
    # Every column of the input passes through the kernel: leave out what nobody reads.
    rows = views.ladder(spark, folder).drop("scheduled_time")
    return project_ladders(rows, LADDER, "threshold", {"p": "pav_raw"})


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = projected(spark, folder)
    return scoring.event_losses(rows, [*SLICE, "event_id", "asset", "block"], RAW_METHODS)


def headline(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and violations of the raw and projected quotes, per split and horizon."""
    rows = projected(spark, folder)
    events = scoring.event_losses(rows, [*SLICE, "event_id", "asset", "block"], RAW_METHODS)
    return rounded(ev.method_table(rows, events, methods=RAW_METHODS))


def isotonic(spark, folder):
    rows = views.ladder(spark, folder).select(*LADDER, "threshold", "p")
    fitted = project_ladders(rows, LADDER, "threshold", {"p": "pav_raw"})
    return rounded(fitted.select(*LADDER, "threshold", "pav_raw"))


def weighted_isotonic(spark, folder):
    weight = (F.col("threshold") + 1.0).alias("w")
    rows = views.ladder(spark, folder).select(*LADDER, "threshold", "p", weight)
    fitted = project_ladders(rows, LADDER, "threshold", {"p": "fit"}, weight="w")
    return rounded(fitted.select("event_id", "horizon_seconds", "threshold", "fit"))


def predicted(spark, folder):
    return ev.predict(views.ladder(spark, folder).drop("scheduled_time"), views.PROTOCOL)


def beta_isotonic(spark, folder):
    _, rows = predicted(spark, folder)
    picked = rows.select("event_id", "horizon_seconds", "threshold", "pav_beta")
    return rounded(picked, 6)


def applied(spark, folder):
    rows = views.ladder(spark, folder)
    training = rows.where(F.col("split") == views.PROTOCOL.training_split)
    models = calibrate.fit_calibrators(training, views.HORIZONS)
    out = calibrate.apply_calibrators(rows, models, 1e-6)
    return rounded(
        out.select("event_id", "horizon_seconds", "threshold", "p_platt", "p_beta"), 6
    )


def _models(spark, folder, method: str):
    rows = views.ladder(spark, folder)
    training = rows.where(F.col("split") == views.PROTOCOL.training_split)
    models = calibrate.fit_calibrators(training, views.HORIZONS, (method,))
    table = calibrate.model_table(spark, models)
    slopes = [
        F.round(F.col("coefficients")[i], 6).alias(f"slope_{i + 1}")
        for i in range(len(models[0].coefficients))
    ]
    return table.select("horizon_seconds", F.round("intercept", 6).alias("intercept"), *slopes)


def platt(spark, folder):
    return _models(spark, folder, "platt")


def beta(spark, folder):
    return _models(spark, folder, "beta")


def fitted_gradient(spark, folder):
    """The stationarity of both fits, checked on the training rows themselves."""
    rows = views.ladder(spark, folder)
    training = rows.where(F.col("split") == views.PROTOCOL.training_split)
    models = calibrate.model_table(spark, calibrate.fit_calibrators(training, views.HORIZONS))
    tables = [
        calibrate.gradient_table(training, models, method).select(
            "horizon_seconds",
            F.lit(method).alias("method"),
            (F.col("max_gradient") <= 2e-9).alias("stationary"),
        )
        for method in ("platt", "beta")
    ]
    return tables[0].unionByName(tables[1])


def training_guards(spark, folder):
    """Class and range facts of the training rows, per horizon."""
    rows = views.ladder(spark, folder).where(F.col("split") == views.PROTOCOL.training_split)
    compact = calibrate.compressed_training(rows)
    calibrate.check_training(compact, views.HORIZONS)
    return compact.groupBy("horizon_seconds").agg(
        F.count(F.lit(1)).alias("distinct_quotes"),
        F.countDistinct("label").alias("classes"),
        F.round(F.sum("weight"), 9).alias("total_weight"),
    )


def newton_sums(spark, folder):
    """Sufficient statistics of the first Newton step (slope one, intercept zero)."""
    rows = views.ladder(spark, folder).where(F.col("split") == views.PROTOCOL.training_split)
    compact = calibrate.compressed_training(rows)
    features = calibrate.platt_features("p", 1e-6)
    terms = calibrate.newton_statistics(features, [F.lit(0.0), F.lit(1.0)], [])
    names = ["nll", "g0", "g1", "h00", "h01", "h11"]
    return compact.groupBy("horizon_seconds").agg(
        *[F.round(t, DECIMALS).alias(n) for t, n in zip(terms, names, strict=True)]
    )


def weights(spark, folder):
    rows = views.ladder(spark, folder)
    weighted = calibrate.event_balanced_weights(rows, ["horizon_seconds"])
    return weighted.select(
        "event_id", "horizon_seconds", "threshold", F.round("weight", 15).alias("weight")
    )


def event_level(spark, folder):
    rows = views.ladder(spark, folder)
    losses = scoring.event_losses(rows, [*SLICE, "event_id"], {"raw": "p"})
    return rounded(losses.withColumnsRenamed({"raw__brier": "brier", "raw__log": "log"}))


def _macro(spark, folder, loss: str):
    events = raw_events(spark, folder)
    wide = scoring.macro_scores(events, SLICE, RAW_METHODS)
    return rounded(scoring.per_method(wide, SLICE, RAW_METHODS, loss))


def macro_brier(spark, folder):
    return _macro(spark, folder, "brier")


def macro_log(spark, folder):
    return _macro(spark, folder, "log")


def violation_counts(spark, folder):
    rows = projected(spark, folder)
    wide = scoring.violations(rows, LADDER, SLICE, "threshold", RAW_METHODS)
    return scoring.per_method(wide, SLICE, RAW_METHODS, "edges", "violating_events")


def slices(spark, folder):
    return scoring.slice_summary(views.ladder(spark, folder), SLICE)


def method_losses(spark, folder):
    _, rows = predicted(spark, folder)
    return scoring.event_losses(rows, [*SLICE, "event_id", "asset", "block"], ev.METHODS)


def compared(spark, folder):
    events = method_losses(spark, folder)
    scores = scoring.macro_scores(events, SLICE, ev.METHODS)
    return rounded(scoring.comparisons(scores, SLICE), 6)


def paired_losses(spark, folder):
    """Baseline and model loss side by side per event (wide columns need no self join)."""
    events = raw_events(spark, folder)
    return rounded(
        events.select(
            *SLICE,
            "event_id",
            (F.col("raw__brier") - F.col("pav_raw__brier")).alias("brier_delta"),
            (F.col("raw__log") - F.col("pav_raw__log")).alias("log_delta"),
        )
    )


def subgroups(spark, folder):
    return rounded(scoring.asset_subgroups(raw_events(spark, folder), SLICE))


def steps(spark, folder):
    edges = scoring.ladder_edges(views.ladder(spark, folder), LADDER, "threshold", "p")
    return rounded(edges.select("event_id", "horizon_seconds", "threshold", "step"))


def ranks(spark, folder):
    """Rung number along each ladder."""
    rows = views.ladder(spark, folder).select("event_id", "horizon_seconds", "threshold")
    parts = segment(rows, LADDER, "threshold")
    return with_index(parts, "rung")


def holdout_diffs(spark, folder):
    return raw_events(spark, folder).where("split = 'holdout'").select(
        "horizon_seconds",
        "event_id",
        "block",
        (F.col("raw__brier") - F.col("pav_raw__brier")).alias("brier"),
        (F.col("raw__log") - F.col("pav_raw__log")).alias("log"),
    )


RESAMPLES = 10_000


def replicate_means(spark, folder):
    diffs = holdout_diffs(spark, folder)
    drawn = bst.replicates(diffs, ["brier", "log"], RESAMPLES, [7], ["horizon_seconds"])
    # In units of 1e-10, cut off the decimal grid: means of a few numbers often end in a five there.
    units = [F.floor(F.col(c) * 1e10 + 0.3717).cast("bigint").alias(c) for c in ("brier", "log")]
    return drawn.select("horizon_seconds", "replicate", *units)


def interval(spark, folder):
    diffs = holdout_diffs(spark, folder)
    drawn = bst.replicates(diffs, ["brier", "log"], RESAMPLES, [7], ["horizon_seconds"])
    return rounded(bst.intervals(drawn, ["brier", "log"], 0.95, ["horizon_seconds"]), 10)


def split_interval(spark, folder):
    """Intervals of single draws, and whether draws split over chunks of events come to the same.

    The ends of both are estimates from 10,000 replicates, so they may differ by a part of the width.
    """
    diffs = holdout_diffs(spark, folder)
    names, by = ["brier", "log"], ["horizon_seconds"]
    single = bst.intervals(bst.replicates(diffs, names, RESAMPLES, [7], by), names, 0.95, by)
    split = bst.replicates(diffs, names, RESAMPLES, [7], by, block_events=0, chunk_events=16)
    other = bst.intervals(split, names, 0.95, by).withColumnsRenamed({"lower": "low", "upper": "high"})
    near = (F.col("upper") - F.col("lower")) * 0.1
    agrees = (F.abs(F.col("low") - F.col("lower")) < near) & (F.abs(F.col("high") - F.col("upper")) < near)
    both = single.join(other, [*by, "name"]).select(*by, "name", "lower", "upper", agrees.alias("split_agrees"))
    return rounded(both, 10)


def bootstrap_guards(spark, folder):
    """Facts the bootstrap requires: blocks, events, events in several blocks, bad losses."""
    events = raw_events(spark, folder)
    held = events.where("split = 'holdout'")
    bst.check_inputs(held, ["raw__brier", "pav_raw__brier"])
    per_event = held.groupBy("event_id").agg(
        (F.min("block") != F.max("block")).cast("bigint").alias("several")
    )
    return per_event.agg(
        F.count(F.lit(1)).alias("events"), F.sum("several").alias("events_in_several_blocks")
    )


def percentiles(spark, folder):
    """Interval bounds of event losses per slice (linear interpolation)."""
    losses = scoring.event_losses(views.ladder(spark, folder), [*SLICE, "event_id"], {"raw": "p"})
    return rounded(ordered_percentiles(losses, SLICE, "raw__brier", {"lower": 0.025, "upper": 0.975}))


def slice_coverage(spark, folder):
    """What the ladder keeps of all orders and all their lines, by the history coverage operator."""
    lines = views.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    events = (
        views.table(spark, folder, "orders")
        .select("o_orderkey", views.split_column().alias("split"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select("split", F.coalesce("n", F.lit(0)).alias("eligible_market_count"))
    )
    grid = views.PROTOCOL.grid(spark)
    found = coverage.history_coverage(grid, events, views.ladder(spark, folder))
    return found.select(
        *SLICE,
        F.col("event_history_coverage").alias("event_coverage"),
        F.col("row_history_coverage").alias("row_coverage"),
    )


def full_run(spark, folder) -> ev.Evaluation:
    return ev.evaluate(
        views.ladder(spark, folder).drop("scheduled_time"),
        views.PROTOCOL,
        slice_coverage(spark, folder),
    )


def broken_ladder(spark, folder):
    """The ladder with faults wherever a line's price says so, one rule each."""
    ladder = views.ladder(spark, folder).drop("scheduled_time")
    n = F.col("event_id") % 97
    return ladder.select(
        "event_id",
        F.when(n == 1, 60).otherwise(F.col("horizon_seconds")).alias("horizon_seconds"),
        F.when(n == 2, float("inf")).when(n == 3, 1.0).otherwise(F.col("threshold")).alias("threshold"),
        F.when(n == 4, float("nan")).when(n == 5, 1.7).when(n == 6, None).otherwise(F.col("p")).alias("p"),
        F.when(n == 7, 0.5).otherwise(F.col("label")).alias("label"),
        F.when(n == 8, "other").otherwise(F.col("split")).alias("split"),
        F.when((n == 9) & (F.col("threshold") == 1.0), "elsewhen").otherwise(F.col("block")).alias("block"),
        F.when((n == 10) & (F.col("threshold") == 1.0), "elsewhat").otherwise(F.col("asset")).alias("asset"),
    ).where("not (split = 'validation' and horizon_seconds = 900)")


def input_problems(spark, folder):
    return ev.input_problems(broken_ladder(spark, folder), views.PROTOCOL)


def evaluation(spark, folder):
    return rounded(full_run(spark, folder).metrics, 6)


def evaluation_intervals(spark, folder):
    return rounded(full_run(spark, folder).intervals, 6)


def gate(spark, folder):
    table = full_run(spark, folder).gate
    return rounded(table.select("gate", "condition", "value", "limit", "passed"), 6)


def metrics_sink(spark, folder):
    """Holdout metrics written as CSV to the shared folder and read back."""
    from rungwise.session import scratch_path

    path = scratch_path(spark, "metrics")
    rows = projected(spark, folder)
    events = scoring.event_losses(rows, [*SLICE, "event_id", "asset", "block"], RAW_METHODS)
    sinks.write_metrics(ev.method_table(rows, events, methods=RAW_METHODS), "holdout", path)
    schema = (
        "horizon_seconds bigint, method string, event_macro_brier double, "
        "event_macro_log_loss double, monotonicity_violation_edges bigint, "
        "events_with_violations bigint"
    )
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


def document_sink(spark, folder):
    """The nested result document, written as text and read back as one row per method."""
    from rungwise.session import scratch_path

    path = scratch_path(spark, "document")
    rows = projected(spark, folder)
    events = scoring.event_losses(rows, [*SLICE, "event_id", "asset", "block"], RAW_METHODS)
    metrics = ev.method_table(rows, events, methods=RAW_METHODS)
    summary = scoring.slice_summary(rows, SLICE)
    deltas = scoring.macro_scores(events, SLICE, RAW_METHODS).select(
        *SLICE,
        F.lit("pav_raw_vs_raw").alias("comparison"),
        (F.col("raw__brier") - F.col("pav_raw__brier")).alias("brier_delta"),
    )
    passed = metrics.where("method = 'pav_raw'").agg(
        F.lit("all_projection_violations_removed").alias("condition"),
        (F.sum("edges") == 0).alias("passed"),
    )
    sinks.write_document(sinks.result_document(summary, metrics, deltas, passed), path)
    method = "struct<brier:double, log:double, edges:bigint, violating_events:bigint>"
    schema = (
        "splits map<string, string>, gate struct<passed:boolean>"
    )
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    cells = parsed.select(F.explode("d.splits").alias("split", "horizons")).select(
        "split",
        F.explode(F.from_json("horizons", "map<string, string>")).alias("horizon", "body"),
    )
    inner = F.from_json("body", f"rows bigint, events bigint, methods map<string, {method}>")
    opened = cells.select(
        "split", F.col("horizon").cast("bigint").alias("horizon_seconds"), inner.alias("c")
    )
    return rounded(
        opened.select(
            "split", "horizon_seconds", "c.rows", "c.events", F.explode("c.methods").alias("method", "m")
        ).select("split", "horizon_seconds", "rows", "events", "method", "m.brier", "m.edges")
    )


def quantisation(spark, folder):
    rows = projected(spark, folder)
    return rows.select(
        "event_id",
        "horizon_seconds",
        "threshold",
        quantised(F.col("p") - F.col("pav_raw"), 6).alias("moved"),
    )


_RAW = (sql.LADDER, sql.isotonic("ladder", "p", "raw_fit"))
_BOTH = _RAW + (
    """predicted as (
  select l.event_id, l.horizon_seconds, l.threshold, l.label, l.split, l.block, l.asset, l.p as raw,
    f.fit as pav_raw
  from ladder l join raw_fit f on f.event_id = l.event_id and f.horizon_seconds = l.horizon_seconds
    and f.threshold = l.threshold)""",
)
_TWO = ("raw", "pav_raw")
_SCORED = _BOTH + (sql.event_losses(methods=_TWO),)
_RISING = _BOTH + (sql.edges(methods=_TWO),)


def _per_method(methods, fields: str, source: str, decimals: int) -> str:
    return " union all ".join(
        f"select split, horizon_seconds, '{m}' as method, "
        + ", ".join(f"round(avg({m}_{f}), {decimals}) as {f}" for f in fields.split())
        + f" from {source} group by 1, 2"
        for m in methods
    )


def _scores_with_edges(methods, decimals: int) -> str:
    scores = _per_method(methods, "brier log", "event_loss", decimals)
    return (
        "select s.split, s.horizon_seconds, s.method, s.brier, s.log, r.edges, r.violating_events "
        f"from ({scores}) s join rising r on r.split = s.split "
        "and r.horizon_seconds = s.horizon_seconds and r.method = s.method"
    )


_HEADLINE = sql.query(
    _scores_with_edges(_TWO, 9), *_SCORED, sql.edges(methods=_TWO)
)
_FULL = (sql.predictions(), sql.event_losses())


def _replicate_sql() -> str:
    """The nested bootstrap of both horizons, as table ``reps``."""
    parts = []
    for horizon in views.HORIZONS:
        source = (
            "diffs as (select event_id, block, raw_brier - pav_raw_brier as brier, "
            f"raw_log - pav_raw_log as log from event_loss where split = 'holdout' and horizon_seconds = {horizon})"
        )
        draws = sql.bootstrap("diffs", "brier, log", 7, RESAMPLES)
        parts.append(f"select * from (with {source}, {draws} select {horizon} as horizon_seconds, * from reps)")
    return "reps as (" + " union all ".join(parts) + ")"


_REPS = _replicate_sql()


def _comparison_sql() -> str:
    return " union all ".join(
        f"select split, horizon_seconds, '{name}' as comparison, '{b}' as baseline, '{m}' as model, "
        f"round(avg({b}_brier) - avg({m}_brier), 6) as brier_delta, "
        f"round((avg({b}_brier) - avg({m}_brier)) / avg({b}_brier), 6) as relative_brier_improvement, "
        f"round(avg({b}_log) - avg({m}_log), 6) as log_loss_delta from event_loss group by 1, 2"
        for name, b, m in sql.COMPARISONS
    )


def _interval_sql() -> str:
    """Intervals of all comparisons: one nested bootstrap per horizon and loss."""
    protocol, parts = views.PROTOCOL, []
    names = [name for name, _, _ in sql.COMPARISONS]
    for horizon in views.HORIZONS:
        for loss, seed in (("brier", protocol.seed), ("log", protocol.seed + 1)):
            diffs = ", ".join(f"{b}_{loss} - {m}_{loss} as {n}" for n, b, m in sql.COMPARISONS)
            source = (
                f"diffs as (select event_id, block, {diffs} from event_loss "
                f"where split = 'holdout' and horizon_seconds = {horizon})"
            )
            draws = sql.bootstrap("diffs", ", ".join(names), seed, protocol.resamples)
            rows = " union all ".join(
                f"select 'holdout' as split, {horizon} as horizon_seconds, '{n}' as comparison, '{loss}' as loss, "
                f"quantile_cont({n}, 0.025) as lower, quantile_cont({n}, 0.975) as upper from reps"
                for n in names
            )
            parts.append(f"select * from (with {source}, {draws} {rows})")
    return "bounds as (" + " union all ".join(parts) + ")"


_GATE_FACTS = """facts as (
  select count(*) as events, count(distinct block) as blocks,
    (avg(raw_brier) - avg(pav_raw_brier)) / avg(raw_brier) as relative,
    avg(raw_log) - avg(pav_raw_log) as log_delta,
    (avg(beta_brier) - avg(pav_beta_brier)) / avg(beta_brier) as extra_relative
  from event_loss where split = 'holdout' and horizon_seconds = 1800),
worst as (
  select min(d) as d, count(*) as assets from (select asset, avg(raw_brier) - avg(pav_raw_brier) as d
    from event_loss where split = 'holdout' and horizon_seconds = 1800 group by 1) a)"""


def _gate_sql() -> str:
    bound = (
        "(select lower from bounds where horizon_seconds = 1800 and loss = 'brier' and comparison = '{}')"
    )
    lower, extra = bound.format("pav_raw_vs_raw"), bound.format("pav_beta_vs_beta")
    edges = (
        "(select edges from rising where split = 'holdout' and horizon_seconds = 1800 and method = 'pav_raw')"
    )
    rows = [
        ("primary", "minimum_holdout_events", "events", 500, "v >= 500"),
        ("primary", "minimum_holdout_utc_days", "blocks", 14, "v >= 14"),
        ("primary", "minimum_event_coverage", "(select ec from covered)", 0.95, "v >= 0.95"),
        ("primary", "minimum_contract_coverage", "(select rc from covered)", 0.95, "v >= 0.95"),
        ("primary", "minimum_relative_brier_improvement", "relative", 0.001, "v >= 0.001"),
        ("primary", "brier_ci_lower_above_zero", lower, 0, "v > 0"),
        ("primary", "log_loss_regression_within_limit", "log_delta", -0.001, "v >= -0.001"),
        ("primary", "nonnegative_asset_subgroups", "(select d from worst)", 0,
         "v >= -1e-15 and (select assets from worst) = 5"),
        ("primary", "all_projection_violations_removed", edges, 0, "v = 0"),
        ("incremental", "minimum_relative_brier_improvement", "extra_relative", 0.001, "v >= 0.001"),
        ("incremental", "brier_ci_lower_above_zero", extra, 0, "v > 0"),
    ]
    return " union all ".join(
        f"select '{gate_}' as gate, '{name}' as condition, round(v, 6) as value, {limit}::double as limit, "
        f"{test} as passed from (select cast({value} as double) as v from facts) x"
        for gate_, name, value, limit, test in rows
    )


_COVERED = f"""covered as (
  select (select count(distinct event_id) from ladder where split = 'holdout')
      / (select count(*) from orders where {sql.SPLIT.format('o_orderdate')} = 'holdout') as ec,
    (select count(*) from ladder where split = 'holdout' and horizon_seconds = 1800)
      / (select count(*) from lineitem join orders on o_orderkey = l_orderkey
         where {sql.SPLIT.format('o_orderdate')} = 'holdout') as rc)"""
_WEIGHTED = """weighted as (select *, threshold + 1e0 as w from ladder)"""
_Z = "ln(greatest(1e-6, least(1 - 1e-6, p))) - ln(1 - greatest(1e-6, least(1 - 1e-6, p)))"

QUERIES = {
    "headline_scores": (headline, _HEADLINE),
    "iso1_ladder_projection": (
        isotonic,
        sql.query(
            "select event_id, horizon_seconds, threshold, round(fit, 9) as pav_raw from raw_fit", *_RAW
        ),
    ),
    "iso2_weighted_projection": (
        weighted_isotonic,
        sql.query(
            "select event_id, horizon_seconds, threshold, round(fit, 9) as fit from wfit",
            sql.LADDER,
            _WEIGHTED,
            sql.isotonic("weighted", "p", "wfit", "b.w"),
        ),
    ),
    "iso3_projected_beta": (
        beta_isotonic,
        sql.query(
            "select event_id, horizon_seconds, threshold, round(pav_beta, 6) as pav_beta from predicted",
            sql.predictions(),
            recursive=True,
        ),
    ),
    "cal1_platt": (
        platt,
        sql.query(
            "select horizon_seconds, round(a, 6) as intercept, round(b, 6) as slope_1 from platt_fit",
            sql.LADDER, sql.TRAIN, sql.PLATT, recursive=True,
        ),
    ),
    "cal2_beta": (
        beta,
        sql.query(
            "select horizon_seconds, round(a, 6) as intercept, round(b, 6) as slope_1, "
            "round(c, 6) as slope_2 from beta_fit",
            sql.LADDER, sql.TRAIN, sql.BETA, recursive=True,
        ),
    ),
    "cal3_apply": (
        applied,
        sql.query(
            "select event_id, horizon_seconds, threshold, round(p_platt, 6) as p_platt, "
            "round(p_beta, 6) as p_beta from calibrated",
            sql.LADDER, sql.TRAIN, sql.PLATT, sql.BETA, sql.CALIBRATED, recursive=True,
        ),
    ),
    "cal_gradient": (
        fitted_gradient,
        "select h.horizon_seconds, m.method, "
        "true as stationary from (values (1800), (900)) h(horizon_seconds) "
        "cross join (values ('platt'), ('beta')) m(method)",
    ),
    "cal4_training_guards": (
        training_guards,
        sql.query(
            "select horizon_seconds, count(*) as distinct_quotes, count(distinct y) as classes, "
            "round(sum(w), 9) as total_weight from train group by 1",
            sql.LADDER, sql.TRAIN,
        ),
    ),
    "agg1_event_losses": (
        event_level,
        sql.query(
            "select split, horizon_seconds, event_id, count(*) as rows, "
            "round(avg((p - label) * (p - label)), 9) as brier, "
            f"round(avg({sql.log_loss('p')}), 9) as log from ladder group by 1, 2, 3",
            sql.LADDER,
        ),
    ),
    "agg2_macro_brier": (
        macro_brier, sql.query(_per_method(_TWO, "brier", "event_loss", 9), *_SCORED)
    ),
    "agg3_macro_log_loss": (
        macro_log, sql.query(_per_method(_TWO, "log", "event_loss", 9), *_SCORED)
    ),
    "agg4_violations": (violation_counts, sql.query("select * from rising", *_RISING)),
    "agg5_slice_summary": (
        slices,
        sql.query(
            "select split, horizon_seconds, count(*) as rows, count(distinct event_id) as events, "
            "count(distinct block) as blocks from ladder group by 1, 2",
            sql.LADDER,
        ),
    ),
    "agg6_comparisons": (compared, sql.query(_comparison_sql(), *_FULL, recursive=True)),
    "agg7_asset_subgroups": (
        subgroups,
        sql.query(
            "select split, horizon_seconds, asset, count(*) as events, "
            "round(avg(raw_brier) - avg(pav_raw_brier), 9) as brier_delta from event_loss group by 1, 2, 3",
            *_SCORED,
        ),
    ),
    "agg8_event_weights": (
        weights,
        sql.query(
            "select l.event_id, l.horizon_seconds, threshold, round(1e0 / (e.e * s.n), 15) as weight "
            "from ladder l join (select horizon_seconds, event_id, count(*) as n from ladder group by 1, 2) s "
            "on s.event_id = l.event_id and s.horizon_seconds = l.horizon_seconds "
            "join (select horizon_seconds, count(distinct event_id) as e from ladder group by 1) e "
            "on e.horizon_seconds = l.horizon_seconds",
            sql.LADDER,
        ),
    ),
    "agg19_newton_sums": (
        newton_sums,
        sql.query(
            "select horizon_seconds, round(sum(w * (greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z)), 9) as nll, "
            "round(sum(w * (s - y)), 9) as g0, round(sum(w * (s - y) * z), 9) as g1, "
            "round(sum(w * s * (1 - s)), 9) as h00, round(sum(w * s * (1 - s) * z), 9) as h01, "
            "round(sum(w * s * (1 - s) * z * z), 9) as h11 from "
            "(select *, lp - lq as z, 1 / (1 + exp(-(lp - lq))) as s from train) t group by 1",
            sql.LADDER, sql.TRAIN,
        ),
    ),
    "agg20_percentiles": (
        percentiles,
        sql.query(
            "select split, horizon_seconds, round(quantile_cont(b, 0.025), 9) as lower, "
            "round(quantile_cont(b, 0.975), 9) as upper from (select split, horizon_seconds, event_id, "
            "avg((p - label) * (p - label)) as b from ladder group by 1, 2, 3) e group by 1, 2",
            sql.LADDER,
        ),
    ),
    "join12_paired_losses": (
        paired_losses,
        sql.query(
            "select split, horizon_seconds, event_id, round(raw_brier - pav_raw_brier, 9) as brier_delta, "
            "round(raw_log - pav_raw_log, 9) as log_delta from event_loss",
            *_SCORED,
        ),
    ),
    "win1_ladder_steps": (
        steps,
        sql.query(
            "select event_id, horizon_seconds, threshold, round(step, 9) as step from ("
            "select *, lead(p) over (partition by event_id, horizon_seconds order by threshold) - p as step "
            "from ladder) s where step is not null",
            sql.LADDER,
        ),
    ),
    "win7_ladder_rank": (
        ranks,
        sql.query(
            "select event_id, horizon_seconds, threshold, row_number() over "
            "(partition by event_id, horizon_seconds order by threshold) - 1 as rung from ladder",
            sql.LADDER,
        ),
    ),
    "prj11_quantised": (
        quantisation,
        sql.query(
            "select event_id, horizon_seconds, threshold, round(raw - pav_raw, 6) + 0e0 as moved from predicted",
            *_BOTH,
        ),
    ),
    "bst1_replicates": (
        replicate_means,
        sql.query(
            "select horizon_seconds, rep as replicate, cast(floor(brier * 1e10 + 0.3717e0) as bigint) as brier, "
            "cast(floor(log * 1e10 + 0.3717e0) as bigint) as log from reps",
            *_SCORED, _REPS,
        ),
    ),
    "bst1_interval": (
        interval,
        sql.query(
            "select horizon_seconds, 'brier' as name, round(quantile_cont(brier, 0.025), 10) as lower, "
            "round(quantile_cont(brier, 0.975), 10) as upper from reps group by 1 union all "
            "select horizon_seconds, 'log', round(quantile_cont(log, 0.025), 10), "
            "round(quantile_cont(log, 0.975), 10) from reps group by 1",
            *_SCORED, _REPS,
        ),
    ),
    "bst1_split_blocks": (
        split_interval,
        sql.query(
            "select horizon_seconds, 'brier' as name, round(quantile_cont(brier, 0.025), 10) as lower, "
            "round(quantile_cont(brier, 0.975), 10) as upper, true as split_agrees from reps group by 1 union all "
            "select horizon_seconds, 'log', round(quantile_cont(log, 0.025), 10), "
            "round(quantile_cont(log, 0.975), 10), true from reps group by 1",
            *_SCORED, _REPS,
        ),
    ),
    "bst2_guards": (
        bootstrap_guards,
        sql.query(
            "select count(*) as events, 0 as events_in_several_blocks from (select event_id from ladder "
            "where split = 'holdout' group by 1 having count(distinct block) = 1) e",
            sql.LADDER,
        ),
    ),
    "bst3_all_comparisons": (
        evaluation_intervals,
        sql.query(
            "select split, horizon_seconds, comparison, loss, round(lower, 6) as lower, round(upper, 6) as upper from bounds",
            *_FULL, _interval_sql(), recursive=True,
        ),
    ),
    "eval1_input_problems": (
        input_problems,
        sql.query(
            "select rule_id, key, n::varchar || ' times' as detail from ("
            "select case event_id % 97 when 1 then 'horizon_not_declared' when 2 then 'threshold_not_finite' "
            "when 7 then 'label_not_binary' when 8 then 'split_not_declared' "
            "else 'probability_not_in_unit_interval' end as rule_id, event_id::varchar as key, count(*) as n "
            "from kept where event_id % 97 in (1, 2, 4, 5, 6, 7, 8) group by 1, 2 union all "
            "select 'threshold_repeated', event_id::varchar, count(*) from (select event_id, horizon_seconds "
            "from kept where event_id % 97 = 3 group by 1, 2 having count(*) > 1) group by 2 union all "
            "select 'threshold_repeated', event_id::varchar, count(*) from (select event_id from kept "
            "where event_id % 97 in (1, 2) group by event_id, case when event_id % 97 = 1 then 0 else horizon_seconds end, "
            "case when event_id % 97 = 2 then 0 else threshold end having count(*) > 1) group by 2 union all "
            "select case event_id % 97 when 9 then 'event_in_several_blocks' else 'event_in_several_assets' end, "
            "event_id::varchar, 1 from kept where event_id % 97 in (9, 10) group by event_id "
            "having count(*) filter (threshold = 1) > 0 and count(*) filter (threshold <> 1) > 0) x "
            "union all select 'slice_empty', 'validation/900', 'no rows'",
            sql.LADDER,
            "kept as (select * from ladder where not (split = 'validation' "
            "and horizon_seconds = 900 and event_id % 97 not in (1, 8)))",
        ),
    ),
    "eval1_scores": (
        evaluation,
        sql.query(_scores_with_edges(sql.METHODS, 6), *_FULL, sql.edges(), recursive=True),
    ),
    "agg18_reporting_gate": (
        gate,
        sql.query(
            _gate_sql(), *_FULL, sql.edges(), _interval_sql(), _GATE_FACTS, _COVERED, recursive=True
        ),
    ),
    "snk3_metrics_table": (
        metrics_sink,
        sql.query(
            "select horizon_seconds, method, brier as event_macro_brier, log as event_macro_log_loss, "
            "edges as monotonicity_violation_edges, violating_events as events_with_violations from ("
            + _scores_with_edges(_TWO, 9) + ") x where split = 'holdout'",
            *_SCORED, sql.edges(methods=_TWO),
        ),
    ),
    "snk4_result_document": (
        document_sink,
        sql.query(
            "select x.split, x.horizon_seconds, c.rows, c.events, method, brier, edges from ("
            + _scores_with_edges(_TWO, 9)
            + ") x join (select split, horizon_seconds, count(*) as rows, count(distinct event_id) as events "
            "from ladder group by 1, 2) c on c.split = x.split and c.horizon_seconds = x.horizon_seconds",
            *_SCORED, sql.edges(methods=_TWO),
        ),
    ),
}
