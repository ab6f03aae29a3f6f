"""Fail-closed rules, provenance records, snapshot differences over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.functions import chain
from rungwise.operators import bindings as binding
from rungwise.operators import compare, quality
from rungwise.session import scratch_path
from rungwise.sources import provenance, quarantine, sinks, tables
from rungwise.workload import sql, views

EMBARGO = 3_600


def snapshot(spark, folder):
    """Snapshot rows with typed cells; faults are those of the quote view."""
    typed = tables.typed_table(views.snapshot_text(spark, folder), tables.SNAPSHOT_COLUMNS)
    return typed.withColumn("label", F.col("gamma_candidate_label").try_cast("double"))


def evidence(spark, folder):
    return tables.typed_table(views.evidence_text(spark, folder), tables.EVIDENCE_COLUMNS)


def counted(violations):
    return violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def evidence_rows(spark, folder):
    return counted(quality.evidence_row_violations(evidence(spark, folder)))


def snapshot_rows(spark, folder):
    return counted(quality.snapshot_row_violations(snapshot(spark, folder), views.LABEL_SOURCE))


def evidence_scan(spark, folder):
    """Evidence written as ordered gzip CSV and scanned back with the closed schema."""
    path = scratch_path(spark, "evidence")
    sinks.write_evidence(views.evidence_text(spark, folder), views.SPLITS, path)
    rows = tables.scan_evidence(spark, path)
    return rows.groupBy("split", "horizon_seconds").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("reference_timestamp").alias("dated"),
        F.sum("resolution_block_number").alias("block_numbers"),
        F.sum(F.try_element_at("payout_vector", F.lit(1)).cast("bigint")).alias("yes"),
        F.count(F.when(F.col("resolution_tx_hash") == F.lower("resolution_tx_hash"), 1)).alias("lowered"),
    )


def profile(spark, folder):
    return compare.candidate_profile(snapshot(spark, folder))


def summary(spark, folder):
    return compare.dataset_summary(snapshot(spark, folder))


def invariants(spark, folder):
    return counted(quality.table_invariants(evidence(spark, folder), chain=True))


def label_edges(spark, folder):
    """Quotes reduced to one label per rung, then the rungs where the label rises."""
    rows = snapshot(spark, folder).where("label is not null and not isnan(threshold)")
    ladder = rows.groupBy("event_id", "horizon_seconds", "threshold").agg(F.max("label").alias("label"))
    return quality.rising_label_edges(ladder).select("event_id", "horizon_seconds", "threshold")


def ladder_equality(spark, folder):
    """Ladders of the two horizons, where one horizon lacks the quotes returned by customers."""
    rows = views.table(spark, folder, "lineitem")
    both = rows.withColumn("horizon_seconds", views.horizons()).where(
        "horizon_seconds = 1800 or l_returnflag <> 'R'"
    )
    named = both.select(
        F.col("l_orderkey").alias("event_id"),
        F.col("l_partkey").alias("market_id"),
        F.col("l_linenumber").alias("threshold"),
        F.lit(1.0).alias("label"),
        "horizon_seconds",
    )
    return quality.ladders_differ(named).select("rule_id", "key")


def timing(spark, folder):
    return counted(quality.protocol_violations(evidence(spark, folder), views.PROTOCOL, chain=True))


def feature_times(spark, folder):
    """Ship dates as feature times against order dates as cutoffs."""
    rows = _dated(spark, folder)
    bad = quality.late_features(
        rows, "l_shipdate", "o_orderdate", EMBARGO, quality.key_text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    return bad.select("rule_id", "key")


def label_times(spark, folder):
    rows = _dated(spark, folder)
    bad = quality.late_labels(
        rows, "l_shipdate", "o_orderdate", 0, quality.key_text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    return bad.select("rule_id", "key")


def _dated(spark, folder):
    orders = views.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = views.table(spark, folder, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def split_overlap(spark, folder):
    """Customers as event groups: whose orders fall into several splits."""
    rows = views.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("event_id"), views.split_column().alias("split")
    )
    return quality.shared_split_events(rows).select("rule_id", "key")


def records(spark, folder):
    return provenance.response_records(views.manifest_documents(spark, folder))


def record_rows(spark, folder):
    return records(spark, folder).select(
        "index", "path", "source", "method", "content_bytes", "content_sha256"
    )


def _problems(spark, folder):
    return provenance.response_problems(
        records(spark, folder), views.PAGE_ENDPOINT, "above", views.HISTORY_ENDPOINT, 1, 2700
    )


def record_problems(spark, folder):
    return counted(_problems(spark, folder))


def record_fields(spark, folder):
    """Landed manifests, some with a field too many or a field of another name."""
    rows = views.manifest_documents(spark, folder)
    k = F.regexp_extract("body", r"order_(\d+)", 1).cast("bigint")
    extra = F.regexp_replace("body", '"gzip_bytes":1', '"gzip_bytes":1,"note":0')
    other = F.regexp_replace("body", '"source":', '"origin":')
    body = F.when(k % 13 == 0, extra).when(k % 17 == 0, other).otherwise(F.col("body"))
    found = provenance.record_field_problems(rows.select(body.alias("body")))
    return found.groupBy("rule_id", "detail").agg(F.count(F.lit(1)).alias("n"))


def logged_methods(spark, folder):
    """A response log that names one method per order priority, two of them not allowed."""
    names = dict(zip(views.PRIORITIES, ("eth_call", *provenance.METHODS[:2], "eth_getCode"), strict=False))
    method = F.lit(None).cast("string")
    for priority, value in names.items():
        method = F.when(F.col("o_orderpriority") == priority, value).otherwise(method)
    rows = views.table(spark, folder, "orders").select(method.alias("method"))
    return provenance.method_problems(rows)


def page_urls(spark, folder):
    return _problems(spark, folder).where("rule_id = 'bad_event_request'").select("key")


def history_bodies(spark, folder):
    return _problems(spark, folder).where("rule_id = 'bad_history_request'").select("key")


def source_hashes(spark, folder):
    """Orders above the median price cite a page digest; the rest cite their customer's."""
    rows = views.table(spark, folder, "orders").select(
        "o_orderkey",
        F.sha2(
            F.concat(
                F.when(F.col("o_orderstatus") == "F", "other").otherwise("gamma"),
                F.col("o_orderkey").cast("string"),
            ),
            256,
        ).alias("content_sha256"),
    )
    known = records(spark, folder).where(F.col("source") == provenance.EVENT_SOURCE)
    return quality.absent(
        rows, known, ["content_sha256"], "event_hash_unknown", quality.key_text("o_orderkey")
    ).select("rule_id", "key")


def token_requests(spark, folder):
    """Tokens of orders that their cited history request did not ask for."""
    token = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("8"), F.col("o_orderkey").cast("string"))).otherwise(
        F.col("o_orderkey").cast("string")
    )
    rows = views.table(spark, folder, "orders").select(
        "o_orderkey",
        token.alias("token"),
        F.sha2(F.concat(F.lit("clob"), F.col("o_orderkey").cast("string")), 256).alias("content_sha256"),
    )
    asked = provenance.requested_tokens(records(spark, folder))
    return quality.absent(
        rows, asked, ["content_sha256", "token"], "token_not_requested", quality.key_text("o_orderkey")
    ).select("rule_id", "key")


def _responses(spark, folder):
    """Line items as node responses: logs for returned lines, blocks for the others."""
    lines = views.table(spark, folder, "lineitem")
    method = F.when(F.col("l_returnflag") == "R", provenance.LOG_METHOD).otherwise(provenance.BLOCK_METHOD)
    return lines.select(
        F.sha2(F.concat_ws("-", "l_returnflag", "l_partkey"), 256).alias("response_sha256"), method.alias("method")
    )


def bundles(spark, folder):
    """Evidence bundles of orders, some with swapped, absent or altered members."""
    key = F.col("o_orderkey") - F.floor(F.col("o_orderkey") / 2000) * 2000
    log = F.sha2(F.concat(F.lit("R-"), key.cast("string")), 256)
    block = F.sha2(F.concat(F.lit("A-"), key.cast("string")), 256)
    first = F.when(F.col("o_orderpriority") == "1-URGENT", block).otherwise(log)
    second = F.when(F.col("o_orderpriority") == "2-HIGH", F.sha2(F.lit("nowhere"), 256)).otherwise(block)
    orders = views.table(spark, folder, "orders").select(first.alias("log_sha256"), second.alias("block_sha256"), "o_orderpriority")
    right = chain.evidence_digest(views.DOMAIN, "log_sha256", "block_sha256")
    digest = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.sha2("log_sha256", 256)).otherwise(right)
    named = orders.select("log_sha256", "block_sha256", digest.alias("digest"))
    found = provenance.bundle_problems(named, _responses(spark, folder), views.DOMAIN)
    return counted(found)


def gaps(spark, folder):
    """Order keys as a request sequence with holes, repeated numbers and foreign request ids."""
    k = F.col("o_orderkey")
    rows = views.table(spark, folder, "orders").where(k % 50 != 0).select(
        k.alias("sequence"), F.when(k % 33 == 0, k + 1).otherwise(k).alias("request_id")
    )
    repeated = rows.where("sequence % 77 = 0")
    found = quality.sequence_gaps(rows.unionByName(repeated), "sequence", "request_id")
    return found.select("rule_id", "key")


def digests(spark, folder):
    """Every order written as a line of its month's gzip text: the digest of the text behind the
    file, and whether that is another one than the file's."""
    path = scratch_path(spark, "archive")
    rows = views.table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey",
        F.to_json(F.struct("o_orderkey")).alias("value"),
    )
    sorted_rows = rows.repartition("month").sortWithinPartitions("month", "o_orderkey").drop("o_orderkey")
    sorted_rows.write.option("compression", "gzip").partitionBy("month").text(path)
    found = provenance.artifact_digests(spark, path, "*.gz")
    return found.select(
        F.regexp_extract("path", r"month=(\d{4}-\d{2})", 1).alias("month"),
        "content_sha256",
        (F.col("sha256") != F.col("content_sha256")).alias("differ"),
    )


def archive_audit(spark, folder):
    """Archive of one gzip text per month against its own digests: altered, lost, unrecorded."""
    path = scratch_path(spark, "archive")
    rows = views.table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.to_json(F.struct("o_orderkey")).alias("value")
    )
    rows.repartition(1, "month").write.option("compression", "gzip").partitionBy("month").text(path)
    month = F.regexp_extract("path", r"month=(\d{4}-\d{2})", 1)
    found = provenance.artifact_digests(spark, path, "*.gz").withColumn("path", month)
    year = F.substring("path", 1, 4)
    recorded = found.select(
        F.when(year == "2001", F.concat(F.lit("x"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(year == "1996", F.reverse("sha256")).otherwise(F.col("sha256")).alias("gzip_sha256"),
        F.when(year == "1997", F.col("sha256")).otherwise(F.col("content_sha256")).alias("content_sha256"),
    )
    return provenance.archive_audit(recorded, found).select("rule_id", "key")


def bindings(spark, folder):
    """Order documents bound to customer digests; open orders carry another digest."""
    customers = views.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256")
    )
    orders = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("document"),
        F.col("o_custkey").cast("string").alias("path"),
        F.when(F.col("o_orderstatus") == "O", F.sha2(F.lit("open"), 256))
        .otherwise(F.sha2(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), 256))
        .alias("expected"),
    )
    return quality.binding_mismatches(orders, customers).select("rule_id", "key")


def count_bindings(spark, folder):
    """Each order's manifest states its lines, its parts and its customer's digest; lines are counted
    from the table, digests read from the customers' documents. Some manifests are wrong."""
    lines = views.table(spark, folder, "lineitem")
    orders = views.table(spark, folder, "orders")
    customers = views.table(spark, folder, "customer")
    name = F.col("l_orderkey").cast("string")
    counted = binding.measured(
        lines.withColumn("name", F.concat(F.lit("o"), name)), "name",
        {"lines": F.count(F.lit(1)), "parts": F.countDistinct("l_partkey")},
    )
    stated = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"))
    order = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    customer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    manifest = F.to_json(
        F.struct(
            F.struct(
                (F.col("n") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("rows"),
                F.when(urgent & (F.col("o_orderstatus") == "F"), F.lit("several")).otherwise(F.col("parts").cast("string")).alias("parts"),
            ).alias("lines"),
            F.array(F.struct(F.sha2(customer, 256).alias("sha256"))).alias("customers"),
        )
    )
    held = orders.join(stated, F.col("o_orderkey") == F.col("l_orderkey"))
    bodies = held.select(order.alias("document"), manifest.alias("body"))
    own = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    digest = F.when(F.col("c_nationkey") == 3, F.lit(None)).when(F.col("c_nationkey") == 5, F.upper(F.sha2(own, 256))).otherwise(
        F.when(F.col("c_nationkey") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(own, 256))
    )
    bodies = bodies.unionByName(customers.select(own.alias("document"), F.to_json(F.struct(digest.alias("sha256"))).alias("body")))

    def one(kind, left_path, right_document, right_path):
        return F.struct(
            F.concat_ws("|", order, F.lit(left_path)).alias("binding"), F.lit(kind).alias("kind"), order.alias("left_document"),
            F.lit(left_path).alias("left_path"), right_document.alias("right_document"), F.lit(right_path).alias("right_path"),
        )

    stated_bindings = held.select(
        F.inline(
            F.array(
                one(binding.COUNT, "$.lines.rows", order, "lines"), one(binding.COUNT, "$.lines.parts", order, "parts"),
                one(binding.DIGEST, "$.customers[0].sha256", customer, "$.sha256"),
            )
        )
    )
    return binding.problems(stated_bindings, bodies, counted).select("rule_id", "key")


FIELDS = ("rows", "parts", "suppliers", "returned")


def _facts(spark, folder, status: str):
    lines = views.table(spark, folder, "lineitem").where(F.col("l_linestatus") == status)
    facts = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("l_partkey").alias("parts"),
        F.max("l_suppkey").alias("suppliers"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
    )
    return compare.unpivot_values(facts, ["l_orderkey"], FIELDS)


def _explained(spark, folder):
    """Urgent orders explain changed rows; others explain nothing."""
    urgent = views.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit("rows").alias("field"), F.lit("urgent").alias("explanation")
    )


def diff(spark, folder):
    return compare.snapshot_diff(
        _facts(spark, folder, "F"), _facts(spark, folder, "O"), _explained(spark, folder), ["l_orderkey"]
    )


def diff_problems(spark, folder):
    found = compare.explanation_problems(diff(spark, folder))
    return found.groupBy("field", "problem").agg(F.count(F.lit(1)).alias("n"))


def diff_gate(spark, folder):
    return compare.diff_gate(diff(spark, folder))


def report_check(spark, folder):
    """A stored report that claims nothing changed in supplier fields, recomputed."""
    recomputed = diff(spark, folder)
    stored = recomputed.withColumn(
        "changed", F.when(F.col("field") == "suppliers", F.lit(False)).otherwise(F.col("changed"))
    )
    wrong = compare.report_mismatches(stored, recomputed, ["l_orderkey", "field"])
    return wrong.select("l_orderkey", "field")


def table_equality(spark, folder):
    """Open and closed line items compared as multisets of (part, quantity, discount)."""
    rows = views.table(spark, folder, "lineitem")
    columns = ["l_partkey", "l_quantity", "l_discount"]
    left = rows.where("l_linestatus = 'O'").select(*columns)
    right = rows.where("l_linestatus = 'F'").select(*columns)
    return compare.table_differences(left, right)


def _candidate_texts(spark, folder):
    """Candidate rows under several aliases, as text, faulty here and there."""
    orders = views.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        key.cast("string").alias("event_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), key.cast("string")))
        .when(F.col("o_orderstatus") == "O", key.cast("string"))
        .otherwise("")
        .alias("eventId"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "0x12").otherwise(views.hex32(key)).alias("conditionId"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(views.iso(F.col("o_orderdate")))
        .alias("endDate"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(views.split_column()).alias("split"),
        F.lit("1800").alias("horizon"),
        F.when(F.col("o_orderpriority") == "5-LOW", '["No","Yes"]').otherwise('["Yes","No"]').alias("outcomes"),
        F.when(F.col("o_totalprice") > 250_000, "Yes").otherwise("0").alias("gamma_candidate_label"),
        F.when(F.col("o_orderstatus") == "P", '["1","0"]').otherwise("").alias("outcomePrices"),
    )


def candidates(spark, folder):
    """Candidate rows with the problems found per kind."""
    rows = tables.normalise_candidates(_candidate_texts(spark, folder))
    return rows.select(
        "event_id", "condition_id", F.unix_seconds("target_at").alias("target_at"), "candidate",
        F.concat_ws(",", "problems").alias("problems"),
    )


def candidate_files(spark, folder):
    """The candidates written as JSON lines and as CSV, some lines torn, and read back through the
    quarantine: lines per fault, candidates accepted, and whether every fault names a line of its own."""
    raw = _candidate_texts(spark, folder)
    names = raw.columns
    torn = F.col("event_id").cast("bigint") % 11 == 0
    json_path, csv_path = scratch_path(spark, "json-lines"), scratch_path(spark, "csv-lines")
    whole = F.to_json(F.struct(*names))
    raw.select(F.when(torn, F.substring(whole, 1, 30)).otherwise(whole).alias("value")).write.text(json_path)
    line = F.to_csv(F.struct(*names), {"escape": '"', "quoteAll": "true"})
    # A file per part, as many as the session has shuffle partitions, each with its own header.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("event_id"), F.lit(parts))
    body = raw.select(part.alias("part"), F.lit(1).alias("o"), F.when(torn, F.substring_index(line, ",", 4)).otherwise(line).alias("value"))
    heads = spark.range(parts).select(F.col("id").alias("part"), F.lit(0).alias("o"), F.lit(",".join(names)).alias("value"))
    body.unionByName(heads).repartition("part").sortWithinPartitions("part", "o").drop("o").write.partitionBy("part").text(csv_path)
    found = []
    for kind, path, header in (("json", json_path, None), ("csv", csv_path, names)):
        good, bad = quarantine.read_candidates(spark, path, header)
        found.append(good.select(F.lit(kind).alias("kind"), F.lit("accepted").alias("outcome"), F.concat_ws(":", "file", "line").alias("key")))
        found.append(bad.select(F.lit(kind).alias("kind"), F.col("rule_id").alias("outcome"), "key"))
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("kind", "outcome").agg(
        F.count(F.lit(1)).alias("lines"), (F.count(F.lit(1)) == F.countDistinct("key")).alias("own_lines")
    )


_Q = f"""q as (
  select l.*, o.*, h.horizon_seconds as h, cast(l_quantity as bigint) as q, l_linestatus = 'O' as yes,
    date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as ship_day
  from lineitem l join orders o on o_orderkey = l_orderkey cross join {sql.HORIZONS})"""


def _rule_counts(rules: dict[str, str], extra: str = "") -> str:
    parts = " union all ".join(
        f"select '{name}' as rule_id, count(*) as n from q where {test} having count(*) > 0"
        for name, test in rules.items()
    )
    return sql.query(parts + extra, _Q)


_COMMON = {
    "non_finite_threshold": "q = 4",
    "non_binary_label": "q = 5",
    "probability_outside_unit_interval": "q = 7",
    "non_positive_horizon": "q = 11",
    "negative_staleness": "q = 13",
    "non_decimal_yes_token": "q = 6",
    "bad_source_history_digest": "q = 8",
    "bad_condition_id": "q = 9",
    "bad_timestamp": "q = 12",
    "empty_identifier": "q = 10",
}
_EVIDENCE = _COMMON | {
    "negative_chain_coordinate": "q = 20",
    "bad_chain_source_digest": "q = 22",
    "bad_block_hash": "q = 21",
    "label_payout_disagreement": "q in (18, 19) or (q = 5 and yes)",
    "label_candidate_disagreement": "q = 17 or (q = 5 and yes)",
}
_SNAPSHOT = _COMMON | {
    "unexpected_label_source": "q = 15",
    "onchain_flag_not_false": "q = 16",
}
_HORIZON = "case when q = 11 then -h else h end"
_LABEL = "case when q = 5 then 0.5e0 when yes then 1e0 else 0e0 end"
_THRESHOLD = "case when q = 4 then 'nan'::double else cast(l_linenumber as double) end"
_CELLS = f"""c as (
  select l_orderkey as e, l_orderkey * 10 + l_linenumber as m, {_HORIZON} as hz, {_THRESHOLD} as t, {_LABEL} as y,
    case when q = 9 then '0x12' else '0x' || lpad(lower(to_hex(l_orderkey * 10 + l_linenumber)), 64, '0') end as cid,
    case when q = 10 then '' else o_orderpriority end as asset,
    case when q = 2 then 'archive' else {sql.SPLIT.format('o_orderdate')} end as split,
    strftime(case when q = 1 then l_shipdate else o_orderdate end, '%Y-%m-%d') as dy, o_orderdate as sch,
    case when q = 6 then 'x1' else cast(l_partkey as varchar) end as tok,
    case when q = 8 then 'U' else '' end || l_partkey as hist,
    case when q = 18 then '[1,1]' when q = 19 then '[]' when yes then '[1,0]' else '[0,1]' end as vec,
    case when q = 20 then -1 else ship_day end as bn, case when q = 21 then 'z' else cast(ship_day as varchar) end as bh,
    l_shipdate as bt, l_suppkey as tx, l_linenumber as li,
    case when q = 22 then 'short' else cast(l_suppkey as varchar) end as src, q, h, l_linenumber as cnt, yes
  from q)"""


def _fd(rule: str, keys: str, fields: str) -> str:
    return (
        f"select '{rule}' as rule_id, count(*) as n from (select {keys} from c group by {keys} "
        f"having count(distinct ({fields})) > 1) x having count(*) > 0"
    )


_INVARIANTS = " union all ".join(
    [
        "select 'duplicate_row' as rule_id, count(*) as n from (select e, m, hz from c group by 1, 2, 3 having count(*) > 1) x having count(*) > 0",
        _fd("event_properties_disagree", "e", "asset, split, dy, sch"),
        _fd("market_properties_disagree", "e, m", "cid, t, y, tok, hist"),
        "select 'duplicate_threshold' as rule_id, count(*) as n from (select e, hz, t from c group by 1, 2, 3 having count(*) > 1) x having count(*) > 0",
        "select 'labels_rise_along_ladder' as rule_id, count(*) as n from (select e, hz from c group by 1, 2 "
        "having min(case when y = 0 then t end) <= max(case when y = 1 then t end)) x having count(*) > 0",
        "select 'ladder_differs_across_horizons' as rule_id, count(*) as n from (select e from ("
        "select e, m, t, y, count(distinct hz) as k from c group by 1, 2, 3, 4) s join (select e, count(distinct hz) as k from c group by 1) d using (e) "
        "group by e having min(s.k) <> min(d.k)) x having count(*) > 0",
        _fd("chain_evidence_disagrees", "cid", "y, vec, bn, bh, bt, tx, li, src"),
    ]
)
_AGE = "case when q = 12 then null else q end"
_DELAY = "epoch(bt) - epoch(sch)"
_TIMING = " union all ".join(
    f"select '{name}' as rule_id, count(*) as n from c where {test} having count(*) > 0"
    for name, test in {
        "undeclared_split": "q = 2",
        "undeclared_asset": "q = 10",
        "undeclared_horizon": "q = 11",
        "scheduled_outside_split": "q = 2",
        "utc_day_differs": "strftime(sch, '%Y-%m-%d') <> dy",
        "cutoff_differs": "q in (3, 11)",
        "future_reference_point": "q = 12",
        "staleness_differs": "q in (12, 13) or (q = 14)",
        "staleness_above_limit": "q > 40 or q = 12",
        "ladder_below_minimum": "cnt < 3",
        "resolution_outside_grace": f"({_DELAY}) < 0 or ({_DELAY}) > {sql.GRACE}",
    }.items()
) + (
    " union all select 'contract_count_differs' as rule_id, count(*) as n from (select e, hz from c group by 1, 2 "
    "having min(cnt) <> count(*) or max(cnt) <> count(*)) x having count(*) > 0"
)
_KEY = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"
_PAIRS = "from lineitem join orders on o_orderkey = l_orderkey"
_BAD_PAGE = "(o_orderstatus = 'P' or o_orderpriority = '5-LOW')"
_BAD_BODY = "(o_orderstatus <> 'O' or o_orderpriority in ('4-NOT SPECIFIED', '3-MEDIUM'))"
_PATH = "case when o_totalprice > 490000 then 'raw/../' else 'raw/' end"
_FACTS = """facts as (
  select l_linestatus as st, l_orderkey, count(*) as rows, max(l_partkey) as parts, max(l_suppkey) as suppliers,
    count(case when l_returnflag = 'R' then 1 end) as returned from lineitem group by 1, 2),
vals as (
  select st, l_orderkey, f.field, f.value from facts cross join lateral (values
    ('rows', cast(rows as varchar)), ('parts', cast(parts as varchar)), ('suppliers', cast(suppliers as varchar)),
    ('returned', cast(returned as varchar))) f(field, value)),
pairs as (
  select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.field, b.field) as field,
    a.value as old, b.value as new from (from vals where st = 'F') a full join (from vals where st = 'O') b
    on a.l_orderkey = b.l_orderkey and a.field = b.field),
diffs as (
  select p.*, old is distinct from new as changed,
    case when p.field = 'rows' and o_orderpriority = '1-URGENT' then 'urgent' end as explanation
  from pairs p left join orders on o_orderkey = l_orderkey)"""

QUERIES = {
    "val1_evidence_rows": (evidence_rows, _rule_counts(_EVIDENCE)),
    "val2_snapshot_rows": (snapshot_rows, _rule_counts(_SNAPSHOT)),
    "src1_snk2_evidence_round_trip": (
        evidence_scan,
        sql.query(
            "select split, hz as horizon_seconds, count(*) as rows, count(case when q <> 12 then 1 end) as dated, "
            "cast(sum(bn) as bigint) as block_numbers, cast(sum(case vec when '[1,0]' then 1 when '[1,1]' then 1 when '[0,1]' then 0 end) as bigint) as yes, "
            "count(*) as lowered from c group by 1, 2",
            _Q, _CELLS,
        ),
    ),
    "agg15_candidate_profile": (
        profile,
        sql.query(
            "select count(*) as candidate_rows, count(distinct e) as candidate_events, "
            "count(distinct (e, hz)) as candidate_curves from c",
            _Q, _CELLS,
        ),
    ),
    "agg17_dataset_summary": (
        summary,
        sql.query(
            "select count(*) as rows, count(distinct e) as events, count(distinct m) as markets, "
            "count(distinct (e, hz)) as curves from c",
            _Q, _CELLS,
        ),
    ),
    "val3_table_invariants": (invariants, sql.query(_INVARIANTS, _Q, _CELLS)),
    "win2_label_edges": (
        label_edges,
        sql.query(
            "select cast(e as varchar) as event_id, hz as horizon_seconds, t as threshold from ("
            "select e, hz, t, max(y) as y, lead(max(y)) over (partition by e, hz order by t) as nx from c "
            "where not isnan(t) group by 1, 2, 3) s where y < nx",
            _Q, _CELLS,
        ),
    ),
    "join11_ladder_equality": (
        ladder_equality,
        "select 'ladder_differs_across_horizons' as rule_id, cast(e as varchar) as key from ("
        "select l_orderkey as e, l_partkey, l_linenumber, max(case when l_returnflag <> 'R' then 1 else 0 end) as both_h "
        "from lineitem group by 1, 2, 3) x group by e having min(both_h) = 0 and max(both_h) = 1",
    ),
    "val4_protocol_timing": (timing, sql.query(_TIMING, _Q, _CELLS)),
    "val5_feature_times": (
        feature_times,
        f"select 'feature_after_cutoff' as rule_id, {_KEY} as key {_PAIRS} "
        f"where l_shipdate > o_orderdate - interval {EMBARGO} second",
    ),
    "val6_label_times": (
        label_times,
        f"select 'label_not_before_cutoff' as rule_id, {_KEY} as key {_PAIRS} where l_shipdate >= o_orderdate",
    ),
    "set5_split_disjointness": (
        split_overlap,
        f"select 'event_in_several_splits' as rule_id, cast(o_custkey as varchar) as key from orders group by o_custkey "
        f"having count(distinct {sql.SPLIT.format('o_orderdate')}) > 1",
    ),
    "src6_response_records": (
        record_rows,
        " union all ".join(
            f"select {i} as index, {_PATH} || '{name}/order_' || o_orderkey || '.json.gz' as path, '{source}' as source, "
            f"'{method}' as method, cast(floor(o_totalprice / 1000) as bigint) as content_bytes, "
            f"sha256('{name}' || o_orderkey) as content_sha256 from orders"
            for i, name, source, method in (
                (0, "gamma", provenance.EVENT_SOURCE, "GET"),
                (1, "clob", provenance.HISTORY_SOURCE, "POST"),
            )
        ),
    ),
    "val7_record_fields": (
        record_fields,
        "select rule_id, detail, 2 * count(*) as n from ("
        "select 'unexpected_field' as rule_id, 'note' as detail from orders where o_orderkey % 13 = 0 union all "
        "select unnest(['unexpected_field', 'missing_field']), unnest(['origin', 'source']) from orders "
        "where o_orderkey % 13 <> 0 and o_orderkey % 17 = 0) x group by 1, 2",
    ),
    "val8_logged_methods": (
        logged_methods,
        "select 'method_not_allowed' as rule_id, m as key, count(*) || ' responses' as detail from ("
        "select case o_orderpriority when '1-URGENT' then 'eth_call' when '4-NOT SPECIFIED' then 'eth_getCode' "
        "when '5-LOW' then '' end as m from orders) x where m is not null group by m",
    ),
    "val7_response_problems": (
        record_problems,
        " union all ".join(
            f"select '{rule}' as rule_id, {times} * count(*) as n from orders where {test} having count(*) > 0"
            for rule, times, test in (
                ("unsafe_path", 2, "o_totalprice > 490000"),
                ("bad_gzip_digest", 2, "o_totalprice < 10000"),
                ("non_positive_size", 2, "o_totalprice < 1000"),
                ("bad_event_request", 1, _BAD_PAGE),
                ("bad_history_request", 1, _BAD_BODY),
            )
        ),
    ),
    "fn13_page_urls": (
        page_urls,
        f"select {_PATH} || 'gamma/order_' || o_orderkey || '.json.gz' as key from orders where {_BAD_PAGE}",
    ),
    "fn14_history_bodies": (
        history_bodies,
        f"select {_PATH} || 'clob/order_' || o_orderkey || '.json.gz' as key from orders where {_BAD_BODY}",
    ),
    "join9_source_hashes": (
        source_hashes,
        "select 'event_hash_unknown' as rule_id, cast(o_orderkey as varchar) as key from orders where o_orderstatus = 'F'",
    ),
    "join9_requested_tokens": (
        token_requests,
        "select 'token_not_requested' as rule_id, cast(o_orderkey as varchar) as key from orders where o_orderpriority = '5-LOW'",
    ),
    "join10_val8_bundles": (
        bundles,
        "with r as (select distinct l_returnflag || '-' || l_partkey as id from lineitem), "
        "b as (select case o_orderpriority when '1-URGENT' then 'U' when '2-HIGH' then 'H' when '3-MEDIUM' then 'M' else 'O' end as kind, "
        "o_orderkey % 2000 as k, 'R-' || (o_orderkey % 2000) in (from r) as has_log, "
        "'A-' || (o_orderkey % 2000) in (from r) as has_block from orders) "
        "select * from (select 'bundle_log_absent' as rule_id, count(*) as n from b where not (case when kind = 'U' then has_block else has_log end) "
        "union all select 'bundle_block_absent', count(*) from b where kind = 'H' or not has_block "
        "union all select 'bundle_order', count(*) from b where kind = 'U' and has_block "
        "union all select 'bundle_digest', count(*) from b where kind = 'M' "
        "union all select 'bundle_repeated', count(*) from (select kind, k from b group by 1, 2 having count(*) > 1) g) x where n > 0",
    ),
    "win5_sequence_gaps": (
        gaps,
        "select rule_id, cast(k as varchar) as key from (select o_orderkey as k, case "
        "when o_orderkey % 77 = 0 then 'sequence_repeated' "
        "when o_orderkey <> 1 and o_orderkey - 1 not in (select o_orderkey from orders where o_orderkey % 50 <> 0) "
        "then 'sequence_gap' when o_orderkey % 33 = 0 then 'request_id_differs' end as rule_id "
        "from orders where o_orderkey % 50 <> 0) x where rule_id is not null",
    ),
    "src8_artifact_digests": (
        digests,
        "select strftime(o_orderdate, '%Y-%m') as month, sha256(string_agg("
        "'{\"o_orderkey\":' || o_orderkey || '}' || chr(10), '' order by o_orderkey)) as content_sha256, "
        "true as differ from orders group by 1",
    ),
    "val11_archive_audit": (
        archive_audit,
        "with m as (select distinct strftime(o_orderdate, '%Y-%m') as month from orders) "
        "select 'gzip_digest_differs' as rule_id, month as key from m where month like '1996%' union all "
        "select 'content_digest_differs', month from m where month like '1997%' union all "
        "select 'response_absent', 'x' || month from m where month like '2001%' union all "
        "select 'response_unrecorded', month from m where month like '2001%'",
    ),
    "val9_count_bindings": (
        count_bindings,
        "with h as (select o_orderkey as k, o_orderstatus as st, o_orderpriority as pr, c_nationkey as n from orders "
        "left join customer on c_custkey = o_custkey where o_orderkey in (select l_orderkey from lineitem)) "
        "select 'binding_differs' as rule_id, 'o' || k || '|$.lines.rows' as key from h where st = 'P' union all "
        "select 'count_not_whole', 'o' || k || '|$.lines.parts' from h where st = 'F' and pr = '1-URGENT' union all "
        "select case when n = 5 then 'digest_malformed' when n = 7 then 'binding_differs' else 'right_side_absent' end, "
        "'o' || k || '|$.customers[0].sha256' from h where n is null or n in (3, 5, 7)",
    ),
    "val9_bindings": (
        bindings,
        "select 'binding_differs' as rule_id, o_orderkey || '|' || o_custkey as key from orders where o_orderstatus = 'O'",
    ),
    "join14_snapshot_diff": (
        diff, sql.query("select l_orderkey, field, old, new, changed, explanation from diffs", _FACTS)
    ),
    "join14_explanation_problems": (
        diff_problems,
        sql.query(
            "select field, problem, count(*) as n from (select field, case when changed and explanation is null then 'missing_explanation' "
            "when not changed and explanation is not null then 'explains_unchanged_field' end as problem from diffs) d "
            "where problem is not null group by 1, 2",
            _FACTS,
        ),
    ),
    "join14_gate": (
        diff_gate,
        sql.query(
            "select count(*) as fields, count(case when changed then 1 end) as changed, "
            "count(case when changed and explanation is null then 1 end) as missing_explanations, "
            "count(case when changed and explanation is null then 1 end) = 0 as gate_passed from diffs",
            _FACTS,
        ),
    ),
    "val10_report_semantics": (
        report_check,
        sql.query("select l_orderkey, field from diffs where field = 'suppliers' and changed", _FACTS),
    ),
    "set7_table_differences": (
        table_equality,
        "select * from (select l_partkey, l_quantity, l_discount, "
        "cast(sum(case when l_linestatus = 'O' then 1 else -1 end) as bigint) as surplus from lineitem group by 1, 2, 3) x "
        "where surplus <> 0",
    ),
    "src3_candidate_aliases": (
        candidates,
        "select cast(o_orderkey as varchar) as event_id, case when o_orderpriority <> '1-URGENT' then "
        "'0x' || lpad(lower(to_hex(o_orderkey)), 64, '0') end as condition_id, "
        "case when o_orderpriority <> '2-HIGH' then cast(epoch(o_orderdate) as bigint) end as target_at, "
        "case when o_orderstatus = 'P' and o_totalprice <= 250000 then null when o_totalprice > 250000 then 1e0 else 0e0 end as candidate, "
        "concat_ws(',', case when o_orderstatus = 'F' then 'conflicting_event_id' end, "
        "case when o_orderpriority = '3-MEDIUM' then 'missing_split' end, "
        "case when o_orderpriority = '1-URGENT' then 'bad_condition_id' end, "
        "case when o_orderpriority = '2-HIGH' then 'bad_target' end, "
        "case when o_orderpriority = '5-LOW' then 'bad_outcome_order' end, "
        "case when o_orderstatus = 'P' and o_totalprice <= 250000 then 'no_consistent_candidate' end) as problems from orders",
    ),
    "src3_candidate_files": (
        candidate_files,
        "with c as (select o_orderkey % 11 = 0 as torn, [x for x in [case when o_orderstatus = 'F' then 'conflicting_event_id' end, "
        "case when o_orderpriority = '3-MEDIUM' then 'missing_split' end, "
        "case when o_orderpriority = '1-URGENT' then 'bad_condition_id' end, "
        "case when o_orderpriority = '2-HIGH' then 'bad_target' end, "
        "case when o_orderpriority = '5-LOW' then 'bad_outcome_order' end, "
        "case when o_orderstatus = 'P' and o_totalprice <= 250000 then 'no_consistent_candidate' end] if x is not null] as ps from orders), "
        "o as (select 'corrupt_line' as outcome from c where torn union all select 'accepted' from c where not torn and len(ps) = 0 "
        "union all select unnest(ps) from c where not torn) "
        "select k.kind, outcome, count(*) as lines, true as own_lines from o, (values ('json'), ('csv')) k(kind) group by all",
    ),
}
