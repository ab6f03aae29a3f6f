"""Label verification over orders (conditions) and line items (resolution logs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.operators import coverage, labels
from rungwise.plans.verify import LOG_IDENTITY, verify_labels
from rungwise.sources import provenance
from rungwise.workload import sql, views

RANGE_SPAN = 200


def _epoch(name: str):
    return F.unix_seconds(name)


def timed_logs(spark, folder):
    return labels.attach_blocks(views.logs(spark, folder), views.blocks(spark, folder))


def windowed(spark, folder):
    """Copies of a log collapse before the joins, so a much repeated log stays one row."""
    unique = labels.distinct_logs(views.logs(spark, folder), LOG_IDENTITY)
    timed = labels.attach_blocks(unique, views.blocks(spark, folder))
    return labels.logs_in_window(timed, views.condition(spark, folder), views.GRACE)


def window_logs(spark, folder):
    return windowed(spark, folder).select(
        "condition_id", "tx_hash", "log_index", "block_number", "removed", "copies"
    )


def log_blocks(spark, folder):
    return timed_logs(spark, folder).groupBy("block_number").agg(
        F.count(F.lit(1)).alias("logs"), _epoch(F.max("block_ts")).alias("block_ts")
    )


def mismatched_hashes(spark, folder):
    """Logs that carry a hash other than their block's: here the tax takes the hash's place."""
    logs = views.logs(spark, folder).join(
        views.table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("condition_id"),
            F.concat_ws("-", "l_partkey", "l_suppkey").alias("tx_hash"),
            F.col("l_linenumber").cast("bigint").alias("log_index"),
            "l_tax",
        ).distinct(),
        ["condition_id", "tx_hash", "log_index"],
    )
    wrong = F.when(F.col("l_tax") == 0.0, views.hex32(F.lit(0))).otherwise(F.col("block_hash"))
    bad = labels.hash_mismatches(
        logs.withColumn("block_hash", wrong), views.blocks(spark, folder)
    )
    return bad.groupBy("block_number").agg(F.count(F.lit(1)).alias("logs"))


def resolutions(spark, folder):
    return labels.classify(views.condition(spark, folder), windowed(spark, folder), views.GRACE)


def classified(spark, folder):
    return resolutions(spark, folder).select("condition_id", "status", "reason", "label")


def unknown_blocks(spark, folder):
    return labels.unknown_blocks(views.logs(spark, folder), views.blocks(spark, folder))


def evidence(spark, folder):
    """What the agreed conditions cite, from the whole verification plan."""
    candidates = views.condition(spark, folder).withColumn("horizon_seconds", views.horizons())
    done = verify_labels(
        candidates,
        views.logs(spark, folder),
        views.blocks(spark, folder),
        pre_coverage(spark, folder),
        views.PROTOCOL,
        unknown_blocks="report",
    )
    return done.rows.where("status = 'agreed'").select(
        "condition_id",
        "horizon_seconds",
        "chain_label",
        F.concat_ws(",", F.col("payout_vector").cast("array<string>")).alias("payouts"),
        "resolution_block_number",
        "resolution_block_hash",
        _epoch("resolution_block_timestamp").alias("resolution_at"),
        "resolution_tx_hash",
        "resolution_log_index",
    )


def deduplicated(spark, folder):
    unique = labels.distinct_logs(timed_logs(spark, folder), LOG_IDENTITY)
    return unique.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("logs"),
        F.sum("copies").alias("copies"),
        F.sum(F.col("conflict").cast("bigint")).alias("conflicts"),
    )


def filter_problems(spark, folder):
    conditions = views.condition(spark, folder).select(
        views.hex32(F.col("condition_id")).alias("condition_id"), "candidate"
    ).where("candidate = 1.0")
    bad = labels.log_filter_problems(
        views.raw_logs(spark, folder), conditions, views.ADDRESS, views.TOPIC
    )
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("logs"))


def metadata_conflicts(spark, folder):
    """Order lines as candidate rows: part and status should not vary within an order."""
    rows = views.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("condition_id"), "l_linestatus", "l_returnflag"
    )
    return labels.candidate_conflicts(rows, ["l_linestatus", "l_returnflag"])


def reduced(spark, folder):
    rows = views.condition(spark, folder).withColumn("horizon_seconds", views.horizons())
    one = labels.one_row_per_condition(rows, ["event_id", "target_at", "split", "candidate"])
    return one.select(
        "condition_id", "event_id", _epoch("target_at").alias("target_at"), "split", "candidate"
    )


def exclusion_report(spark, folder):
    return labels.exclusions(resolutions(spark, folder))


def window_summary(spark, folder):
    table = labels.search_summary(
        views.condition(spark, folder), views.blocks(spark, folder), views.GRACE, RANGE_SPAN
    )
    return table.withColumn("start_at", _epoch("start_at"))


def joined_rows(spark, folder):
    rows = views.condition(spark, folder).withColumn("horizon_seconds", views.horizons())
    found = resolutions(spark, folder).select("condition_id", "status")
    return rows.join(found, "condition_id")


def row_resolution(spark, folder):
    return joined_rows(spark, folder).select(
        "condition_id", "horizon_seconds", "event_id", "split", "status"
    )


def agreed_events(spark, folder):
    return coverage.complete_agreed_events(joined_rows(spark, folder))


def condition_status(spark, folder):
    return coverage.status_counts(resolutions(spark, folder))


def pre_coverage(spark, folder):
    """All candidates count as retained history; expected events include unlogged ones."""
    rows = views.condition(spark, folder).withColumn("horizon_seconds", views.horizons())
    found = coverage.cell_counts(rows, "history_retained")
    return found.withColumns(
        {
            "expected_events": F.col("history_retained_events"),
            "expected_rows": F.col("history_retained_rows"),
        }
    )


def post_coverage(spark, folder):
    table = coverage.label_coverage(pre_coverage(spark, folder), joined_rows(spark, folder))
    return table.select(
        *coverage.CELL,
        "expected_events",
        "expected_rows",
        "retained_events",
        "retained_rows",
        F.round("event_coverage", 12).alias("event_coverage"),
        F.round("row_coverage", 12).alias("row_coverage"),
    )


def verified(spark, folder):
    """The whole verification plan: coverage after the complete-event gate."""
    candidates = views.condition(spark, folder).withColumn("horizon_seconds", views.horizons())
    done = verify_labels(
        candidates,
        views.logs(spark, folder),
        views.blocks(spark, folder),
        pre_coverage(spark, folder),
        views.PROTOCOL,
        unknown_blocks="report",
    )
    return done.coverage.select(
        *coverage.CELL,
        "retained_events",
        "retained_rows",
        F.round("event_chain_given_history_coverage", 12).alias("event_coverage"),
        F.round("row_chain_given_history_coverage", 12).alias("row_coverage"),
    )


def algebra(spark, folder):
    rows = joined_rows(spark, folder)
    kept = coverage.complete_agreed_events(rows)
    retained = rows.join(kept, [*coverage.CELL, "event_id"], "left_semi")
    return coverage.status_algebra(resolutions(spark, folder), rows, retained)


def _delays(spark, folder):
    """Delay of each condition's only log behind its target; negative for early ones, null where
    the block is unknown (such conditions count in no percentile)."""
    unique = labels.one_log_per_condition(windowed(spark, folder)).where("n_logs = 1")
    timed = unique.select("condition_id", F.col("log.block_ts").alias("block_ts"))
    delay = F.unix_seconds("block_ts") - F.unix_seconds("target_at")
    return timed.join(views.condition(spark, folder), "condition_id").withColumn("delay_seconds", delay)


def latency(spark, folder):
    profile = labels.latency_profile(_delays(spark, folder))
    return profile.select(
        "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")]
    )


def spread(spark, folder):
    profile = labels.latency_profile(labels.event_spread(_delays(spark, folder)))
    return profile.select(
        "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")]
    )


def decoded_logs(spark, folder):
    raw = views.raw_logs(spark, folder)
    typed = provenance.resolution_logs(raw)
    return typed.select(
        F.substring("condition_id", 3, 64).alias("condition"),
        "block_number",
        "log_index",
        "slot_count",
        F.concat_ws(",", F.col("payouts").cast("array<string>")).alias("payouts"),
    )


def headers(spark, folder):
    raw = views.blocks(spark, folder).select(
        F.concat(F.lit("0x"), F.lower(F.hex("number"))).alias("number"),
        "hash",
        F.concat(F.lit("0x"), F.lower(F.hex(F.unix_seconds("ts")))).alias("timestamp"),
    )
    return provenance.block_headers(raw).select("number", "hash", _epoch("ts").alias("ts"))


_LABELS = (sql.CONDITION, sql.CLASSIFIED)
_ROWS = f"""joined as (
  select r.condition_id, r.event_id, r.split, r.status, horizon_seconds
  from resolved r cross join {sql.HORIZONS}),
whole as (
  select split, horizon_seconds, event_id, count(*) as n from joined group by 1, 2, 3
  having bool_and(status = 'agreed')),
cells as (
  select j.split, j.horizon_seconds, count(distinct j.event_id) as ee, count(*) as er
  from joined j group by 1, 2),
held as (
  select c.*, coalesce(w.re, 0) as re, coalesce(w.rr, 0) as rr from cells c left join (
    select split, horizon_seconds, count(*) as re, cast(sum(n) as bigint) as rr from whole group by 1, 2) w
  on w.split = c.split and w.horizon_seconds = c.horizon_seconds)"""
_PROFILE = (
    "count(*) as n, min(d) as min, max(d) as max, round(quantile_cont(d, 0.5), 6) as p50, "
    "round(quantile_cont(d, 0.9), 6) as p90, round(quantile_cont(d, 0.95), 6) as p95, "
    "round(quantile_cont(d, 0.99), 6) as p99"
)
_DELAY = """delay as (
  select c.event_id, cast(epoch(block_ts) - epoch(target_at) as bigint) as d
  from per_condition p join condition c on c.condition_id = p.condition_id where n = 1)"""
_DAY = "date_diff('day', date '1970-01-01', cast({0} as date))"
_STATUS = "('agreed'), ('missing'), ('ambiguous'), ('gamma_disagreement')"

QUERIES = {
    "join5_logs_in_window": (
        window_logs,
        sql.query(
            f"select condition_id, tx_hash, log_index, {_DAY.format('mined')} as block_number, "
            "min(removed) as removed, count(*) as copies from in_window group by 1, 2, 3, 4",
            *_LABELS,
        ),
    ),
    "join6_logs_with_blocks": (
        log_blocks,
        sql.query(
            f"select {_DAY.format('mined')} as block_number, count(*) as logs, "
            "cast(epoch(max(block_ts)) as bigint) as block_ts from log group by 1",
            sql.CONDITION,
        ),
    ),
    "join6_hash_mismatches": (
        mismatched_hashes,
        f"select {_DAY.format('l_shipdate')} as block_number, count(*) as logs from lineitem "
        "where l_tax = 0 and l_shipdate in (select o_orderdate from orders) group by 1",
    ),
    "join6_unknown_blocks": (
        unknown_blocks,
        sql.query(
            f"select 'block_unknown' as rule_id, {_DAY.format('mined')}::varchar as key, "
            "count(*)::varchar || ' logs' as detail from log where block_ts is null group by mined",
            sql.CONDITION,
        ),
    ),
    "lbl1_evidence": (
        evidence,
        sql.query(
            "select r.condition_id, horizon_seconds, r.candidate as chain_label, p.yes || ',' || p.no as payouts, "
            f"{_DAY.format('p.block_ts')} as resolution_block_number, "
            f"'0x' || lpad(lower(to_hex({_DAY.format('p.block_ts')})), 64, '0') as resolution_block_hash, "
            "cast(epoch(p.block_ts) as bigint) as resolution_at, p.tx_hash as resolution_tx_hash, "
            "cast(p.log_index as bigint) as resolution_log_index "
            "from resolved r join per_condition p on p.condition_id = r.condition_id "
            f"cross join {sql.HORIZONS} where status = 'agreed'",
            *_LABELS,
        ),
    ),
    "join7_lbl1_resolutions": (
        classified,
        sql.query(
            "select condition_id, status, reason, case when status = 'agreed' then candidate end as label "
            "from resolved",
            *_LABELS,
        ),
    ),
    "lbl2_distinct_logs": (
        deduplicated,
        sql.query(
            "select condition_id, count(*) as logs, cast(sum(n) as bigint) as copies, "
            "cast(sum(case when lo <> hi then 1 else 0 end) as bigint) as conflicts from ("
            "select condition_id, mined, tx_hash, log_index, count(*) as n, "
            "min(removed || '/' || yes || '/' || no) as lo, max(removed || '/' || yes || '/' || no) as hi "
            "from log group by 1, 2, 3, 4) d group by 1",
            sql.CONDITION,
        ),
    ),
    "lbl3_log_filter": (
        filter_problems,
        "select problem, count(*) as logs from (select case when l_quantity = 2 then 'different_address' "
        "when l_quantity = 3 then 'fewer_than_two_topics' when l_quantity = 1 then 'different_topic' "
        "when o_orderstatus = 'F' or o_orderkey is null then 'condition_not_requested' end as problem "
        "from lineitem left join orders on o_orderkey = l_orderkey) x where problem is not null group by 1",
    ),
    "lbl4_candidate_conflicts": (
        metadata_conflicts,
        "select l_orderkey as condition_id from lineitem group by 1 "
        "having count(distinct l_linestatus || l_returnflag) > 1",
    ),
    "lbl4_one_row_per_condition": (
        reduced,
        sql.query(
            "select condition_id, event_id, cast(epoch(target_at) as bigint) as target_at, split, candidate "
            "from condition",
            sql.CONDITION,
        ),
    ),
    "lbl5_exclusions": (
        exclusion_report,
        sql.query("select condition_id, status, reason from resolved where status <> 'agreed'", *_LABELS),
    ),
    "lbl6_search_windows": (
        window_summary,
        sql.query(
            "select cast(epoch(d) as bigint) as start_at, n as condition_count, clamped, from_block, to_block, "
            f"case when to_block < from_block then 0 when to_block = from_block then 1 "
            f"else cast(ceil((to_block - from_block) / {RANGE_SPAN - 1}) as bigint) end as ranges from ("
            "select d, n, fin > head as clamped, (select min(b) from block where ts >= d) as from_block, "
            "case when fin > head then (select max(b) from block) "
            "else (select min(b) from block where ts >= fin) - 1 end as to_block from ("
            "select date_trunc('day', target_at) as d, count(*) as n, "
            f"date_trunc('day', target_at) + interval 1 day + interval {sql.GRACE} second as fin, "
            "(select max(ts) from block) as head from condition group by 1) w) x",
            sql.CONDITION,
            f"block as (select distinct o_orderdate as ts, {_DAY.format('o_orderdate')} as b from orders)",
        ),
    ),
    "join8_row_resolutions": (
        row_resolution,
        sql.query("select condition_id, horizon_seconds, event_id, split, status from joined", *_LABELS, _ROWS),
    ),
    "agg12_complete_events": (
        agreed_events,
        sql.query("select split, horizon_seconds, event_id from whole", *_LABELS, _ROWS),
    ),
    "agg13_status_counts": (
        condition_status,
        sql.query(
            f"select s.status, count(r.status) as n from (values {_STATUS}) s(status) "
            "left join resolved r on r.status = s.status group by 1",
            *_LABELS,
        ),
    ),
    "agg10_label_coverage": (
        post_coverage,
        sql.query(
            "select split, horizon_seconds, ee as expected_events, er as expected_rows, re as retained_events, "
            "rr as retained_rows, round(re / ee, 12) as event_coverage, round(rr / er, 12) as row_coverage from held",
            *_LABELS, _ROWS,
        ),
    ),
    "verify_labels": (
        verified,
        sql.query(
            "select split, horizon_seconds, re as retained_events, rr as retained_rows, "
            "round(re / ee, 12) as event_coverage, round(rr / er, 12) as row_coverage from held",
            *_LABELS, _ROWS,
        ),
    ),
    "agg14_status_algebra": (
        algebra,
        sql.query(
            "select count(*) as conditions_total, "
            + ", ".join(
                f"count(case when status = '{s}' then 1 end) as conditions_{s}, "
                f"2 * count(case when status = '{s}' then 1 end) as rows_{s}"
                for s in coverage.STATUSES
            )
            + ", 2 * count(*) as rows_total, (select cast(sum(n) as bigint) from whole) as retained_rows, "
            "true as conditions_sum_ok, true as rows_sum_ok, true as retained_within_agreed, "
            "bool_and(status = 'agreed') as all_verified from resolved",
            *_LABELS, _ROWS,
        ),
    ),
    "agg22_label_latency": (
        latency, sql.query(f"select {_PROFILE} from delay", *_LABELS, _DELAY)
    ),
    "agg22_event_spread": (
        spread,
        sql.query(
            f"select {_PROFILE} from (select max(d) - min(d) as d from delay group by event_id) e",
            *_LABELS, _DELAY,
        ),
    ),
    "src7_fn7_decoded_logs": (
        decoded_logs,
        "select case when l_quantity = 3 then null else lpad(lower(to_hex(l_orderkey)), 64, '0') end as condition, "
        f"{_DAY.format('l_shipdate')} as block_number, cast(l_linenumber as bigint) as log_index, "
        "case when l_discount <> 0 and l_tax <> 0 then 2 end as slot_count, "
        "case when l_discount = 0 or l_tax = 0 then '' when l_linestatus = 'O' then '1,0' else '0,1' end as payouts "
        "from lineitem",
    ),
    "src7_block_headers": (
        headers,
        f"select distinct {_DAY.format('o_orderdate')} as number, "
        f"'0x' || lpad(lower(to_hex({_DAY.format('o_orderdate')})), 64, '0') as hash, "
        "cast(epoch(o_orderdate) as bigint) as ts from orders",
    ),
}
