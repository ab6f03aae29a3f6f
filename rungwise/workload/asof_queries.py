"""Point-in-time selection, completeness gates and coverage over activity histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.operators import asof, coverage
from rungwise.sources import price_store
from rungwise.workload import sql, views

TOLERANCE = views.ASOF_TOLERANCE
TOLERANCES = (3_600, 21_600, 43_200, 86_400, 172_800)
MINIMUM = 3
SECOND = 1_000_000


def _epoch(name: str):
    return F.unix_seconds(name)


def _decisions(spark, folder, hourly: bool):
    return _shown(
        asof.asof_decisions(views.history(spark, folder, hourly), views.cutoffs(spark, folder), TOLERANCE)
    )


def _stored(spark, folder, hourly: bool):
    """The same decisions from a history stored once, asked by the cutoffs of two halves apart."""
    store = price_store.stored(views.history(spark, folder, hourly))
    cutoffs = views.cutoffs(spark, folder)
    early = F.dayofmonth("cutoff") <= 15
    halves = [price_store.decisions(spark, store, cutoffs.where(part), TOLERANCE) for part in (early, ~early)]
    return _shown(halves[0].unionByName(halves[1]))


def stored_backward(spark, folder):
    return _stored(spark, folder, False)


def stored_rejections(spark, folder):
    return _stored(spark, folder, True)


def _shown(found):
    return found.select(
        "token",
        _epoch("cutoff").alias("cutoff"),
        "status",
        "reason",
        F.round("p", 9).alias("p"),
        "staleness_seconds",
    )


def backward(spark, folder):
    return _decisions(spark, folder, hourly=False)


def rejections(spark, folder):
    return _decisions(spark, folder, hourly=True)


def forward(spark, folder):
    """First order date not earlier than each ship date."""
    times = views.table(spark, folder, "lineitem").select(F.col("l_shipdate").alias("at"))
    found = asof.first_at_or_after(views.blocks(spark, folder), times)
    return found.select(
        _epoch("at").alias("at"), "number", _epoch("block_ts").alias("block_ts")
    )


def most_recent(spark, folder):
    """Newest point of every token."""
    points = views.history(spark, folder, hourly=False)
    return points.groupBy("token").agg(
        F.unix_micros(F.max("ts")).alias("ts"), F.round(F.max_by("p", "ts"), 9).alias("p")
    )


def cutoff_decisions(spark, folder):
    return asof.cutoff_rows(
        views.contract(spark, folder),
        views.history(spark, folder, hourly=False),
        views.HORIZONS,
        TOLERANCE,
    )


def horizon_rows(spark, folder):
    rows = asof.expand_horizons(views.contract(spark, folder), views.HORIZONS)
    return rows.select(
        "token", "event_id", "horizon_seconds", _epoch("cutoff").alias("cutoff"), "utc_day"
    )


def curves(spark, folder):
    return asof.complete_curves(cutoff_decisions(spark, folder), MINIMUM)


def retained(spark, folder):
    decided = cutoff_decisions(spark, folder)
    rows = asof.retained_rows(decided, asof.complete_curves(decided, MINIMUM))
    return rows.select(
        "token",
        "event_id",
        "horizon_seconds",
        "event_horizon_contract_count",
        F.round("p", 9).alias("p"),
    )


def _grid(spark):
    cells = [(s, h) for s in ("first", "second", "third") for h in views.HORIZONS]
    return spark.createDataFrame(cells, "split string, horizon_seconds bigint")


def _events(spark, folder):
    return views.contract(spark, folder).groupBy("event_id", "split").agg(
        F.count(F.lit(1)).alias("eligible_market_count")
    )


def history_coverage(spark, folder):
    decided = cutoff_decisions(spark, folder)
    rows = asof.retained_rows(decided, asof.complete_curves(decided, MINIMUM))
    table = coverage.history_coverage(_grid(spark), _events(spark, folder), rows)
    return table.withColumns(
        {
            "event_history_coverage": F.round("event_history_coverage", 12),
            "row_history_coverage": F.round("row_history_coverage", 12),
        }
    )


def coverage_totals(spark, folder):
    decided = cutoff_decisions(spark, folder)
    rows = asof.retained_rows(decided, asof.complete_curves(decided, MINIMUM))
    return coverage.coverage_totals(
        coverage.history_coverage(_grid(spark), _events(spark, folder), rows)
    )


def coverage_document(spark, folder):
    """Nested coverage document, unfolded again to one row per cell and metric."""
    decided = cutoff_decisions(spark, folder)
    rows = asof.retained_rows(decided, asof.complete_curves(decided, MINIMUM))
    flat = coverage.history_coverage(_grid(spark), _events(spark, folder), rows)
    document = coverage.nested_document(flat)
    splits = document.select(
        F.explode(
            F.from_json("document", "map<string, map<string, map<string, double>>>")
        ).alias("split", "h")
    )
    cells = splits.select("split", F.explode("h").alias("horizon", "metrics"))
    return cells.select("split", "horizon", F.explode("metrics").alias("metric", "value")).select(
        "split", "horizon", "metric", F.round("value", 9).alias("value")
    )


def sensitivity(spark, folder):
    return asof.staleness_sensitivity(
        views.contract(spark, folder),
        views.history(spark, folder, hourly=False),
        views.HORIZONS,
        TOLERANCES,
        MINIMUM,
    )


def grid_gaps(spark, folder):
    return coverage.missing_cells(views.ladder(spark, folder), _grid(spark))


def outside_vocabulary(spark, folder):
    return coverage.undeclared_values(
        views.ladder(spark, folder), "asset", views.SELECTION.assets
    )


def reconciled(spark, folder):
    """Declared cells (from orders and lines directly) against recomputed ladder cells."""
    rows = views.ladder(spark, folder)
    found = coverage.cell_counts(rows, "history_retained").withColumns(
        {
            "expected_events": F.col("history_retained_events"),
            "expected_rows": F.col("history_retained_rows"),
        }
    )
    # The declaration counts raw line items, so repeated lines make its row counts disagree.
    lines = views.table(spark, folder, "lineitem")
    orders = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), views.split_column().alias("split")
    )
    raw = (
        lines.select(F.col("l_orderkey").alias("event_id"))
        .join(orders, "event_id")
        .withColumn("horizon_seconds", views.horizons())
    )
    declared = coverage.cell_counts(raw, "history_retained").withColumns(
        {
            "expected_events": F.col("history_retained_events") - 1,
            "expected_rows": F.col("history_retained_rows"),
        }
    )
    return coverage.reconcile(declared, found)


_HORIZON_ROWS = f"""wanted as (
  select token, event_id, split, horizon_seconds, on_day,
    event_end - to_seconds(horizon_seconds) as cutoff from contract cross join {sql.HORIZONS})"""
_FINE = sql.HISTORY.format(ts="ts")
_HOURLY = sql.HISTORY.format(ts="date_trunc('hour', ts)")
_NOON = "noon as (select token, event_end as cutoff from contract)"
_DECIDED = f"""decided as (
  select w.*, f.p, f.age, {sql.asof_reason(TOLERANCE)} as reason
  from wanted w join found f on f.token = w.token and f.cutoff = w.cutoff),
curve as (
  select event_id, horizon_seconds, count(case when reason is null then 1 end) as fresh,
    count(*) as total from decided group by 1, 2),
kept as (
  select d.*, c.total from decided d join curve c on c.event_id = d.event_id
    and c.horizon_seconds = d.horizon_seconds where fresh = total and total >= {MINIMUM})"""
_ASOF = (_FINE, _HORIZON_ROWS, sql.asof("wanted"), _DECIDED)
_COVERED = f"""expected as (
  select split, count(distinct event_id) as ee, count(*) as er from contract group by 1),
held as (
  select split, horizon_seconds, count(distinct event_id) as he, count(*) as hr from kept group by 1, 2),
cover as (
  select g.split, h.horizon_seconds, coalesce(ee, 0) as expected_events, coalesce(er, 0) as expected_rows,
    coalesce(he, 0) as history_retained_events, coalesce(hr, 0) as history_retained_rows,
    case when coalesce(ee, 0) = 0 then 0e0 else coalesce(he, 0) / ee end as event_history_coverage,
    case when coalesce(er, 0) = 0 then 0e0 else coalesce(hr, 0) / er end as row_history_coverage
  from (values ('first'), ('second'), ('third')) g(split) cross join {sql.HORIZONS}
    left join expected e on e.split = g.split
    left join held k on k.split = g.split and k.horizon_seconds = h.horizon_seconds)"""


def _decision_sql(history: str) -> str:
    return sql.query(
        f"select token, cast(epoch(cutoff) as bigint) as cutoff, "
        "case when reason is null then 'selected' else 'rejected' end as status, reason, "
        "case when reason is null then round(p, 9) end as p, "
        "case when reason is null then age // 1000000 end as staleness_seconds "
        f"from (select *, {sql.asof_reason(TOLERANCE)} as reason from found) f",
        history, _NOON, sql.asof("noon"),
    )


QUERIES = {
    "join1_asof_backward": (backward, _decision_sql(_FINE)),
    "join2_asof_rejections": (rejections, _decision_sql(_HOURLY)),
    "join1_stored_history": (stored_backward, _decision_sql(_FINE)),
    "join2_stored_history": (stored_rejections, _decision_sql(_HOURLY)),
    "join3_asof_forward": (
        forward,
        "select cast(epoch(s.at) as bigint) as at, "
        "date_diff('day', date '1970-01-01', cast(min(o.ts) as date)) as number, "
        "cast(epoch(min(o.ts)) as bigint) as block_ts "
        "from (select distinct l_shipdate as at from lineitem) s left join "
        "(select distinct o_orderdate as ts from orders) o on o.ts >= s.at group by s.at",
    ),
    "srt3_most_recent": (
        most_recent,
        "select user_id as token, epoch_us(max(ts)) as ts, "
        "round(arg_max(least(value, 100.0) / 100.0, ts), 9) as p from events group by 1",
    ),
    "prj6_horizon_expansion": (
        horizon_rows,
        sql.query(
            "select token, event_id, horizon_seconds, cast(epoch(cutoff) as bigint) as cutoff, "
            "strftime(on_day, '%Y-%m-%d') as utc_day from wanted",
            _FINE, _HORIZON_ROWS,
        ),
    ),
    "agg11_complete_curves": (
        curves,
        sql.query(
            "select event_id, horizon_seconds, fresh as eligible_history_contract_count, "
            "total as strict_market_contract_count, "
            f"case when fresh = total and total >= {MINIMUM} then 'selected' else 'rejected' end as status, "
            f"case when fresh = total and total >= {MINIMUM} then null else 'incomplete_fresh_curve' end as reason "
            "from curve",
            *_ASOF,
        ),
    ),
    "agg11_retained_rows": (
        retained,
        sql.query(
            "select token, event_id, horizon_seconds, total as event_horizon_contract_count, "
            "round(p, 9) as p from kept",
            *_ASOF,
        ),
    ),
    "agg9_history_coverage": (
        history_coverage,
        sql.query(
            "select split, horizon_seconds, expected_events, expected_rows, history_retained_events, "
            "history_retained_rows, round(event_history_coverage, 12) as event_history_coverage, "
            "round(row_history_coverage, 12) as row_history_coverage from cover",
            *_ASOF, _COVERED,
        ),
    ),
    "agg16_coverage_totals": (
        coverage_totals,
        sql.query(
            "select cast(sum(history_retained_rows) as bigint) as candidate_rows, "
            "cast(sum(history_retained_events) as bigint) as candidate_curves, "
            "cast(sum(case when horizon_seconds = 1800 then expected_events end) as bigint) as selected_events "
            "from cover",
            *_ASOF, _COVERED,
        ),
    ),
    "snk6_coverage_document": (
        coverage_document,
        sql.query(
            " union all ".join(
                f"select split, cast(horizon_seconds as varchar) as horizon, '{m}' as metric, "
                f"round(cast({m} as double), 9) as value from cover"
                for m in (
                    "expected_events", "expected_rows", "history_retained_events",
                    "history_retained_rows", "event_history_coverage", "row_history_coverage",
                )
            ),
            *_ASOF, _COVERED,
        ),
    ),
    "agg21_staleness_sensitivity": (
        sensitivity,
        sql.query(
            "select horizon_seconds, tol as tolerance_seconds, count(*) as expected_events, "
            "cast(sum(total) as bigint) as expected_rows, "
            f"count(case when fresh = total and total >= {MINIMUM} then 1 end) as retained_events, "
            f"cast(coalesce(sum(case when fresh = total and total >= {MINIMUM} then total end), 0) as bigint) as retained_rows "
            "from (select event_id, horizon_seconds, tol, count(*) as total, "
            "count(case when not conflict and point_ts is not null and age <= tol * 1000000::bigint then 1 end) as fresh "
            "from wanted w join found f on f.token = w.token and f.cutoff = w.cutoff cross join (values "
            + ", ".join(f"({t})" for t in TOLERANCES)
            + ") t(tol) group by 1, 2, 3) c group by 1, 2",
            _FINE, _HORIZON_ROWS, sql.asof("wanted"),
        ),
    ),
    "set2_grid_completeness": (
        grid_gaps,
        sql.query(
            "select g.split, h.horizon_seconds, 'missing' as problem from "
            f"(values ('first'), ('second'), ('third')) g(split) cross join {sql.HORIZONS} "
            "where (g.split, h.horizon_seconds) not in (select split, horizon_seconds from ladder) union all "
            "select distinct split, horizon_seconds, 'undeclared' from ladder "
            "where split not in ('first', 'second', 'third')",
            sql.LADDER,
        ),
    ),
    "set3_vocabulary": (
        outside_vocabulary,
        sql.query(
            "select asset, count(*) as rows from ladder where asset not in "
            "('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1",
            sql.LADDER,
        ),
    ),
    "join13_coverage_reconcile": (
        reconciled,
        sql.query(
            "select f.split, f.horizon_seconds, r.rule from (select split, horizon_seconds, count(*) as n, "
            "count(distinct event_id) as e from ladder group by 1, 2) f join (select "
            + sql.SPLIT.format("o_orderdate")
            + " as split, count(*) as n, count(distinct o_orderkey) as e from lineitem "
            "join orders on l_orderkey = o_orderkey group by 1) d on d.split = f.split "
            "cross join lateral (values ('count_expected_events', d.e - 1 <> f.e), "
            "('count_history_retained_events', d.e <> f.e), ('count_expected_rows', d.n <> f.n), "
            "('count_history_retained_rows', d.n <> f.n), "
            "('nested_history_retained_events', d.e > d.e - 1)) r(rule, fires) where fires",
            sql.LADDER,
        ),
    ),
}
