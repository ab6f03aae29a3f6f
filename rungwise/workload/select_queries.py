"""Nested event documents: eligibility, deduplication, request plans, canonical order."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.functions.text import asset_of_title, fill_template
from rungwise.functions.times import split_of, utc_text, zoned_timestamp
from rungwise.operators import compare, digest_tree, seen_state, select
from rungwise.operators.ordered import side_by_side
from rungwise.plans.collect import deduplicated_events, selected_pages, snapshot_of
from rungwise.session import scratch_path, written
from rungwise.sources import nested, ordered_files, sinks
from rungwise.workload import sql, views


def events(spark, folder):
    return nested.event_pages(views.event_documents(spark, folder))


def selected(spark, folder):
    return select.select_events(events(spark, folder), views.SELECTION)


def flattened(spark, folder):
    rows = nested.market_rows(events(spark, folder))
    return rows.select(
        "event_id", "event_title", "event_end_date", "event_closed",
        F.col("id").alias("market_id"), "conditionId", "question", "groupItemTitle", "closed",
        "outcomePrices", "clobTokenIds",
    )


def points(spark, folder):
    found = nested.history_points(views.history_documents(spark, folder))
    return found.select(
        "token", F.unix_seconds("ts").alias("ts"), F.round("p", 9).alias("p"), "problem"
    )


def series(spark, folder):
    """Customers ask for the history of the user of the same number; most have none."""
    asked = views.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("token")
    )
    return nested.requested_series(
        asked, nested.history_points(views.history_documents(spark, folder))
    )


def event_reason_counts(spark, folder):
    dated = events(spark, folder).withColumn("_end", zoned_timestamp("endDate"))
    rows = dated.select(select.event_reasons(views.SELECTION, "_end").alias("reasons"))
    return select.reason_counts(rows)


def market_reason_counts(spark, folder):
    return select.reason_counts(select.market_decisions(selected(spark, folder)))


def market_decision_rows(spark, folder):
    rows = select.market_decisions(selected(spark, folder))
    return rows.select("event_id", "market_id", F.concat_ws(",", "reasons").alias("reasons"), "status")


def event_decision_rows(spark, folder):
    rows = select.event_decisions(selected(spark, folder))
    return rows.select(
        "event_id",
        F.concat_ws(",", "reasons").alias("reasons"),
        "status",
        "total_nested_market_count",
        "eligible_market_count",
    )


def contract_rows(spark, folder):
    rows = select.contracts(selected(spark, folder))
    return rows.select("event_id", "market_id", "asset", "split", "threshold", "label", "yes_token", "no_token")


def questions(spark, folder):
    """Question texts rebuilt from template and group title, against the given ones."""
    rows = nested.market_rows(events(spark, folder))
    same = F.col("question").eqNullSafe(fill_template("event_title", "groupItemTitle"))
    return rows.select("event_id", "clobTokenIds", same.alias("matches"))


def assets(spark, folder):
    rows = events(spark, folder)
    return rows.select(
        F.col("id").alias("event_id"), asset_of_title("title", views.SELECTION.assets).alias("asset")
    )


def splits(spark, folder):
    rows = views.table(spark, folder, "orders")
    return rows.select("o_orderkey", split_of("o_orderdate", views.SELECTION.splits).alias("split"))


def fingerprints(spark, folder):
    """Does the fingerprint stay when markets change places, and change with one of their fields?"""
    rows = events(spark, folder)
    altered = F.transform("markets", lambda m: m.withField("closed", ~m["closed"]))
    kept = F.col("id").cast("bigint") % 7 != 0
    marked = rows.select(
        F.col("id").alias("event_id"),
        select.selection_fingerprint().alias("straight"),
        select.selection_fingerprint(F.reverse("markets")).alias("turned"),
        select.selection_fingerprint(F.when(kept, F.col("markets")).otherwise(altered)).alias("changed"),
    )
    return marked.select(
        "event_id",
        (F.col("straight") == F.col("turned")).alias("same_reordered"),
        (F.col("straight") == F.col("changed")).alias("same_altered"),
    )


def pages(spark, folder):
    return nested.event_pages(views.overlapping_pages(spark, folder))


ORDER = ["window", "page", "position"]


def _fingerprints(spark, folder):
    return pages(spark, folder).select(
        "id",
        *ORDER,
        F.unhex(select.selection_fingerprint()).alias("selection"),
        F.unhex(F.sha2("canonical", 256)).alias("full"),
        F.col("title").alias("payload"),
    )


def first_seen(spark, folder):
    return select.first_seen(_fingerprints(spark, folder), ORDER)


def landed_windows(spark, folder):
    """Every window of pages landed by itself, the later one first, on the state of those before."""
    rows = _fingerprints(spark, folder)  # read by window: the other window's pages are not parsed
    state = seen_state.new_state(rows, ORDER)
    for window in (1, 0):
        seen_state.land(state, rows.where(F.col("window") == window), ORDER, str(window))
    return seen_state.first_seen(spark, state)


def distinct_events(spark, folder):
    fields = [F.col("id").alias("event_id"), F.size("markets").alias("markets")]
    return deduplicated_events(pages(spark, folder), ORDER, fields)


def window_union(spark, folder):
    """Monthly windows with inclusive borders, from both ends, merged without the copies."""
    rows = views.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    early = rows.where("o_orderstatus <> 'P'")
    late = rows.where("o_orderstatus <> 'O'")
    merged = select.union_windows([early, late], "o_orderkey")
    return merged.select("o_orderkey", "o_custkey", "o_orderstatus", "copies", "conflict")


def repeated_ids(spark, folder):
    rows = views.table(spark, folder, "lineitem")
    return select.repeated_keys(rows, "l_orderkey", "l_linenumber")


def overlaps(spark, folder):
    """Orders of a customer whose thirty days overlap the next order's."""
    rows = views.table(spark, folder, "orders").select(
        "o_custkey",
        F.col("o_orderdate").alias("start"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + 30 * 86_400_000_000).alias("end"),
        F.col("o_orderkey").alias("name"),
    )
    return select.overlapping_intervals(rows, ["o_custkey"], "start", "end", "name")


def requests(spark, folder):
    """History requests of at most twenty parts per supplier."""
    rows = (
        views.table(spark, folder, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.max("l_shipdate").alias("end"))
        .withColumn("end", F.to_timestamp(F.lit("2002-01-01")))
    )
    plan = select.request_batches(
        rows.withColumn("token", F.col("l_partkey").cast("string")), "l_suppkey", "token", "l_partkey", "end", 2700
    )
    return plan.select(
        "l_suppkey", "batch_index", F.concat_ws(",", "tokens").alias("tokens"), "start_ts", "end_ts"
    )


def _ladder_rows(spark, folder):
    return views.ladder(spark, folder).select(
        "split", "scheduled_time", F.col("event_id").cast("string").alias("event_id"),
        "horizon_seconds", "threshold",
    ).withColumn("market_id", F.concat_ws("-", "event_id", "threshold"))


def ordered_table(spark, folder):
    """The order kept in files: places from the manifest and the scan, nothing sorted on reading."""
    path = scratch_path(spark, "ordered")
    ordered_files.write(_ladder_rows(spark, folder), views.SPLITS, path, rows_per_file=20_000)
    return ordered_files.with_places(spark, path).select("event_id", "horizon_seconds", "threshold", "position")


def ordered(spark, folder):
    """Canonical order written down as the position of every row in the whole output."""
    rows = _ladder_rows(spark, folder)
    placed = select.with_position(select.canonical_order(rows, views.SPLITS), "position")
    return placed.select("event_id", "horizon_seconds", "threshold", "position")


LABEL_SOURCE = views.LABEL_SOURCE


def _quotes(contracts):
    """Two quotes per contract of selected events, one and two minutes before each cutoff."""
    rows = contracts.select("token", "event_end", "threshold")
    ages = F.array(*[F.lit(a).cast("bigint") for a in (1860, 1920, 960, 1150)])
    spread = rows.withColumn("age", F.explode(ages))
    return spread.select(
        "token",
        F.timestamp_micros(F.unix_micros("event_end") - F.col("age") * 1_000_000).alias("ts"),
        F.round(F.pmod(F.col("threshold") / 1000, F.lit(1.0)), 6).alias("p"),
        F.sha2("token", 256).alias("source_history_sha256"),
        F.lit(None).cast("string").alias("problem"),
    )


def collected(spark, folder):
    chosen = written(selected_pages(pages(spark, folder), ORDER, views.SELECTION), "selected")
    offered = written(select.contracts(chosen), "contracts")
    return snapshot_of(chosen, _quotes(offered), views.SELECTION, LABEL_SOURCE, contracts=offered)


def snapshot(spark, folder):
    rows = collected(spark, folder).rows
    return rows.select(
        "event_id", "market_id", "horizon_seconds", "scheduled_time", "cutoff_time", "threshold",
        "gamma_candidate_label", F.round("reference_probability", 9).alias("reference_probability"),
        "reference_timestamp", "staleness_seconds", "event_horizon_contract_count",
    )


def snapshot_coverage(spark, folder):
    return collected(spark, folder).coverage


def snapshot_sink(spark, folder):
    """Candidate table written as ordered gzip CSV, scanned back with the closed schema."""
    from rungwise.sources.tables import scan_snapshot

    path = scratch_path(spark, "snapshot")
    sinks.write_snapshot(collected(spark, folder).rows, views.SPLITS, path)
    rows = scan_snapshot(spark, path)
    return rows.select(
        "event_id", "market_id", "horizon_seconds", utc_text("scheduled_time").alias("scheduled_time"),
        utc_text("cutoff_time").alias("cutoff_time"), "threshold",
        F.col("label").alias("gamma_candidate_label"),
        F.round("reference_probability", 9).alias("reference_probability"),
        utc_text("reference_timestamp").alias("reference_timestamp"),
        "staleness_seconds", "event_horizon_contract_count",
    )


def audit_sink(spark, folder):
    """Event decisions with their reason arrays written as Parquet and read back."""
    path = scratch_path(spark, "audit")
    sinks.write_table(select.event_decisions(selected(spark, folder)), path, ["status"])
    return select.reason_counts(spark.read.parquet(path))


KEYS = ("event_id", "market_id", "horizon_seconds")


def _altered(rows):
    """The table with a number changed here and there."""
    hit = (F.col("horizon_seconds") == 900) & (F.col("market_id").cast("bigint") % 101 == 0)
    p = F.col("reference_probability")
    return rows.withColumn("reference_probability", F.when(hit, p + 2.0).otherwise(p))


def replay(spark, folder):
    """The stored snapshot, with a number altered here and there, against one rebuilt from the
    documents: each altered row shows on both sides, and nothing else does."""
    path = scratch_path(spark, "stored-snapshot")
    digest_tree.write(_altered(collected(spark, folder).rows), KEYS, path)
    changed = digest_tree.differing_keys(spark, path, collected(spark, folder).rows, KEYS)
    return changed.select("event_id", "market_id", "surplus")


def replay_cost(spark, folder):
    """How the tree narrows the comparison: rows in all, rows altered, and whether the buckets to be
    compared are those of altered rows and no others."""
    rows = written(collected(spark, folder).rows, "snapshot")
    trees = []
    for table in (rows, _altered(rows)):
        bucketed = digest_tree.with_buckets(table, KEYS)
        trees.append(written(digest_tree.tree(digest_tree.leaf_digests(bucketed)), "tree"))
    found = {bucket for _, bucket in digest_tree.differing_buckets(*trees)}
    found_whole = compare.key_differences(_altered(rows), rows, KEYS)  # of all rows, without the tree
    changed = written(found_whole.where("surplus > 0"), "changed")
    wanted = digest_tree.with_buckets(changed, KEYS).select(digest_tree.BUCKET).distinct()
    listed = spark.createDataFrame([(b,) for b in found], f"{digest_tree.BUCKET} int")
    odd = wanted.exceptAll(listed).unionByName(listed.exceptAll(wanted))
    counts = side_by_side(rows.agg(F.count(F.lit(1)).alias("rows")), changed.agg(F.count(F.lit(1)).alias("altered")))
    return side_by_side(counts, odd.agg((F.count(F.lit(1)) == 0).alias("only_their_buckets")))


_EVENT_RULES = """all_event_rule as (
  select k, event_id, pos, reason from event_rule union all select k, event_id, pos, reason from late_rule)"""
_SNAP = f"""snap as (
  select c.event_id, cast(c.k * 10 + c.n as varchar) as market_id, h.horizon_seconds, o_orderdate as scheduled,
    c.price * 1000e0 as threshold, case when c.rf = 'A' then 1e0 else 0e0 end as label,
    round(fmod(c.price * 1000e0 / 1000e0, 1e0), 6) as p, c.split,
    count(*) over (partition by c.event_id, h.horizon_seconds) as n_contracts
  from chosen c cross join {sql.HORIZONS})"""
_SNAP_ROWS = (
    "select event_id, market_id, horizon_seconds, strftime(scheduled, '%Y-%m-%dT%H:%M:%SZ') as scheduled_time, "
    "strftime(scheduled - to_seconds(horizon_seconds), '%Y-%m-%dT%H:%M:%SZ') as cutoff_time, threshold, "
    "label as gamma_candidate_label, p as reference_probability, "
    "strftime(scheduled - to_seconds(horizon_seconds) - interval 60 second, '%Y-%m-%dT%H:%M:%SZ') as reference_timestamp, "
    "60 as staleness_seconds, n_contracts as event_horizon_contract_count from snap"
)
_ISO_DATE = "strftime(o_orderdate, '%Y-%m-%d')"
_GROUP = "case when q = 1 then null when q = 2 then 'between 10 and 20' else '$' || cast(price as varchar) || 'k' end"

QUERIES = {
    "src4_flatten_events": (
        flattened,
        sql.query(
            "select ev.event_id, title as event_title, "
            "case when bad_date then 'not-a-date' else strftime(ev.o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as event_end_date, "
            "closed as event_closed, case when q = 15 then '' else cast(l.k * 10 + n as varchar) end as market_id, "
            "case when q = 14 then null else '0x' || lpad(lower(to_hex(l.k * 10 + n)), 64, '0') end as \"conditionId\", "
            f"case when q = 3 then 'another question' else asset || ' above ' || ({_GROUP}) || ' on ' || "
            "strftime(ev.o_orderdate, '%Y-%m-%d') || '?' end as question, "
            f"{_GROUP} as \"groupItemTitle\", q <> 4 as closed, "
            "case when q = 11 then '[\"0.5\",\"0.5\"]' when q = 12 then '[\"1\"]' when rf = 'A' then '[\"1\",\"0\"]' "
            "else '[\"0\",\"1\"]' end as \"outcomePrices\", "
            "'[\"' || (l.k * 10 + n) || '\",\"' || (l.k * 10 + n + case when q = 13 then 0 else 1000000000000 end) || '\"]' as \"clobTokenIds\" "
            "from ev join lines l on l.k = ev.k",
            sql.MARKETS,
        ).replace("closed as event_closed", "ev.closed as event_closed"),
    ),
    "src5_history_points": (
        points,
        "select cast(user_id as varchar) as token, cast(floor(epoch(ts)) as bigint) as ts, "
        "round(least(value, 100.0) / 100.0, 9) as p, cast(null as varchar) as problem from events",
    ),
    "src5_requested_series": (
        series,
        "select cast(c_custkey as varchar) as token, count(user_id) as points from customer "
        "left join events on user_id = c_custkey group by 1",
    ),
    "prj1_event_reasons": (
        event_reason_counts,
        sql.query("select reason, count(*) as n from event_rule group by 1", sql.MARKETS),
    ),
    "prj2_market_reasons": (
        market_reason_counts,
        sql.query("select reason, count(*) as n from market_rule group by 1", sql.MARKETS),
    ),
    "prj2_market_decisions": (
        market_decision_rows,
        sql.query(
            "select j.event_id, case when q = 15 then '' else cast(j.k * 10 + j.n as varchar) end as market_id, "
            "coalesce(string_agg(r.reason, ',' order by r.pos), '') as reasons, "
            "case when count(r.reason) = 0 then 'passed' else 'rejected' end as status "
            "from judged j left join market_rule r on r.k = j.k and r.n = j.n group by j.event_id, j.k, j.n, q",
            sql.MARKETS,
        ),
    ),
    "prj3_event_decisions": (
        event_decision_rows,
        sql.query(
            "select ev.event_id, coalesce(string_agg(r.reason, ',' order by r.pos), '') as reasons, "
            "case when count(r.reason) = 0 then 'selected' else 'rejected' end as status, "
            "any_value(ev.total) as total_nested_market_count, coalesce(any_value(c.kept), 0) as eligible_market_count "
            "from ev left join all_event_rule r on r.k = ev.k left join rechecked c on c.k = ev.k group by ev.k, ev.event_id",
            sql.MARKETS, _EVENT_RULES,
        ),
    ),
    "prj3_contracts": (
        contract_rows,
        sql.query(
            "select event_id, cast(k * 10 + n as varchar) as market_id, asset, split, price * 1000e0 as threshold, "
            "case when rf = 'A' then 1e0 else 0e0 end as label, cast(k * 10 + n as varchar) as yes_token, "
            "cast(k * 10 + n + 1000000000000 as varchar) as no_token from chosen",
            sql.MARKETS,
        ),
    ),
    "prj4_question_template": (
        questions,
        sql.query(
            "select ev.event_id, '[\"' || (l.k * 10 + n) || '\",\"' || (l.k * 10 + n + case when q = 13 then 0 else 1000000000000 end) || '\"]' as \"clobTokenIds\", "
            "(case when q = 3 then 'another question' when q = 1 then null else 'ok' end) is not distinct from "
            "(case when title is null or q = 1 then null else 'ok' end) as matches from ev join lines l on l.k = ev.k",
            sql.MARKETS,
        ),
    ),
    "prj5_asset_of_title": (
        assets,
        sql.query(
            "select event_id, case when title is not null and asset in ('1-URGENT', '2-HIGH', '3-MEDIUM') then asset end as asset from ev",
            sql.MARKETS,
        ),
    ),
    "join4_split_of_time": (
        splits,
        "select o_orderkey, case when o_orderdate < timestamp '1998-01-01' then 'development' "
        "when o_orderdate < timestamp '2000-01-01' then 'validation' "
        "when o_orderdate < timestamp '2001-01-01' then 'holdout' end as split from orders",
    ),
    "prj7_selection_view": (
        fingerprints,
        # An event without markets has nothing to alter.
        "select cast(o_orderkey as varchar) as event_id, true as same_reordered, "
        "o_orderkey % 7 <> 0 or o_orderkey not in (select l_orderkey from lineitem) as same_altered from orders",
    ),
    "win4_first_seen": (
        first_seen,
        sql.query(
            "select event_id as id, title as payload, 1 as duplicates, "
            "case when total > 0 then 1 else 0 end as unused_field_changes, false as changed from ev",
            sql.MARKETS,
        ),
    ),
    "win4_landed_windows": (
        landed_windows,
        sql.query(
            "select event_id as id, title as payload, 1 as duplicates, "
            "case when total > 0 then 1 else 0 end as unused_field_changes, false as changed from ev",
            sql.MARKETS,
        ),
    ),
    "win4_distinct_events": (
        distinct_events,
        sql.query(
            "select event_id, case when total > 0 then total end as markets from ev", sql.MARKETS
        ),
    ),
    "set4_window_union": (
        window_union,
        "select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'F' then 2 else 1 end as copies, "
        "false as conflict from orders",
    ),
    "set6_repeated_keys": (
        repeated_ids,
        "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    ),
    "win3_interval_overlap": (
        overlaps,
        "select o_custkey, o_orderkey as left, nx as right from (select *, "
        "lead(o_orderkey) over w as nx, lead(o_orderdate) over w as nd from orders "
        "window w as (partition by o_custkey order by o_orderdate, o_orderkey)) x "
        "where nd < o_orderdate + interval 30 day",
    ),
    "win6_request_batches": (
        requests,
        "select l_suppkey, b as batch_index, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) as tokens, "
        "cast(epoch(timestamp '2002-01-01') as bigint) - 2700 as start_ts, "
        "cast(epoch(timestamp '2002-01-01') as bigint) as end_ts from (select l_suppkey, l_partkey, "
        "(row_number() over (partition by l_suppkey order by l_partkey) - 1) // 20 as b "
        "from (select distinct l_suppkey, l_partkey from lineitem) d) x group by 1, 2",
    ),
    "srt1_canonical_order": (
        ordered,
        sql.query(
            "select cast(event_id as varchar) as event_id, horizon_seconds, threshold, row_number() over "
            "(order by case split when 'development' then 0 when 'validation' then 1 else 2 end, "
            "scheduled_time, event_id, -horizon_seconds, threshold) - 1 as position from ladder",
            sql.LADDER,
        ),
    ),
    "srt1_ordered_files": (
        ordered_table,
        sql.query(
            "select cast(event_id as varchar) as event_id, horizon_seconds, threshold, row_number() over "
            "(order by case split when 'development' then 0 when 'validation' then 1 else 2 end, "
            "scheduled_time, event_id, -horizon_seconds, threshold) - 1 as position from ladder",
            sql.LADDER,
        ),
    ),
    "collect_snapshot": (snapshot, sql.query(_SNAP_ROWS, sql.MARKETS, _SNAP)),
    "collect_coverage": (
        snapshot_coverage,
        sql.query(
            f"select s.split, h.horizon_seconds, count(distinct event_id) as expected_events, count(event_id) as expected_rows, "
            "count(distinct event_id) as history_retained_events, count(event_id) as history_retained_rows, "
            "case when count(event_id) = 0 then 0e0 else 1e0 end as event_history_coverage, "
            "case when count(event_id) = 0 then 0e0 else 1e0 end as row_history_coverage "
            "from (values ('development'), ('validation'), ('holdout')) s(split) "
            f"cross join {sql.HORIZONS} left join chosen c on c.split = s.split group by 1, 2",
            sql.MARKETS,
        ),
    ),
    "snk1_src2_snapshot_round_trip": (snapshot_sink, sql.query(_SNAP_ROWS, sql.MARKETS, _SNAP)),
    "snk5_audit_table": (
        audit_sink,
        sql.query("select reason, count(*) as n from all_event_rule group by 1", sql.MARKETS, _EVENT_RULES),
    ),
    "val12_replay": (
        replay,
        sql.query(
            "select event_id, market_id, unnest([1, -1]) as surplus from snap "
            "where horizon_seconds = 900 and cast(market_id as bigint) % 101 = 0",
            sql.MARKETS, _SNAP,
        ),
    ),
    "val12_replay_cost": (
        replay_cost,
        sql.query(
            "select count(*) as rows, count(case when horizon_seconds = 900 and cast(market_id as bigint) % 101 = 0 then 1 end) "
            "as altered, true as only_their_buckets from snap",
            sql.MARKETS, _SNAP,
        ),
    ),
}
