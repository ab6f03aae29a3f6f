"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.functions import chain, documents, numeric, text, times
from rungwise.operators import compare, quality
from rungwise.workload import sql, views

UNITS = {"ECONOMY": "k", "SMALL": " million", "STANDARD": "%", "LARGE": " bps", "MEDIUM": "B"}


def thresholds(spark, folder):
    """Prices, brand numbers and ambiguous texts of parts."""
    part = views.table(spark, folder, "part")
    price = F.col("p_retailprice").cast("string")
    unit = F.lit("")
    for kind, suffix in UNITS.items():
        unit = F.when(F.col("p_type") == kind, suffix).otherwise(unit)
    priced = F.concat("p_name", F.lit(" above $"), price, unit, F.lit(" today"))
    double = F.concat("p_brand", F.lit(" above "), price)
    return part.select(
        "p_partkey",
        F.round(text.threshold(priced), 6).alias("price"),
        text.threshold("p_brand").alias("brand"),
        text.threshold(double).alias("ambiguous"),
        text.threshold("p_name").alias("named"),
    )


def timestamps(spark, folder):
    """UTC texts with and without zone; only zoned ones may parse."""
    rows = views.table(spark, folder, "orders")
    base = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    zone = (
        F.when(F.col("o_orderstatus") == "F", "Z")
        .when(F.col("o_orderstatus") == "O", "+02:00")
        .otherwise("")
    )
    value = F.concat(base, zone)
    return rows.select(
        "o_orderkey",
        F.unix_seconds(times.utc_timestamp(value)).alias("strict"),
        F.unix_seconds(times.zoned_timestamp(value)).alias("zoned"),
        times.utc_text("o_orderdate").alias("shown"),
    )


def whole_seconds(spark, folder):
    rows = views.table(spark, folder, "events")
    halves = F.timestamp_micros(F.floor(F.unix_micros("ts") / 500_000) * 500_000)
    return rows.select("event_id", times.whole_epoch_seconds(halves).alias("seconds"))


def day_windows(spark, folder):
    """Daily windows between a customer's first and last order, borders included once."""
    spans = views.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"),
        F.timestamp_micros(F.unix_micros(F.max("o_orderdate")) + 3_600_000_000).alias("last"),
    )
    windows = spans.select("o_custkey", F.explode(times.daily_windows("first", "last")).alias("w"))
    return windows.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("windows"),
        F.unix_seconds(F.min("w.start")).alias("first_start"),
        F.unix_seconds(F.max("w.end")).alias("last_end"),
        F.sum(F.unix_seconds("w.end") - F.unix_seconds("w.start")).alias("covered"),
    )


def block_ranges(spark, folder):
    """Block ranges between order and ship day of every line, one hundred blocks at a time."""
    rows = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", views.day_number("l_shipdate").alias("last"), F.col("l_partkey").alias("first")
    )
    ranges = rows.select(
        "l_orderkey", F.explode(times.block_ranges("first", "last", 1000)).alias("r")
    )
    return ranges.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("ranges"),
        F.min("r.first").alias("lowest"),
        F.max("r.last").alias("highest"),
        F.sum(F.col("r.last") - F.col("r.first")).alias("steps"),
    )


def hex_values(spark, folder):
    rows = views.table(spark, folder, "orders")
    number = F.concat(F.lit("0x"), F.hex("o_orderkey"))
    padded = F.concat(F.lit("0x0"), F.hex("o_orderkey"))
    return rows.select(
        "o_orderkey",
        chain.quantity(number).alias("quantity"),
        chain.quantity(padded).alias("padded"),
        chain.quantity_text(F.concat(number, F.lit("0" * 20))).alias("wide"),
        chain.hex_bytes(F.upper(views.hex32(F.col("o_orderkey"))), 32).alias("upper_prefix"),
        chain.hex_bytes(F.concat(F.lit("0x"), F.upper(views.word(F.col("o_orderkey")))), 32).alias("id"),
    )


def payloads(spark, folder):
    rows = views.raw_logs(spark, folder)
    decoded = chain.resolution_payload("data")
    return rows.groupBy(
        decoded["slot_count"].alias("slot_count"),
        F.when(
            decoded["payouts"].isNotNull(),
            F.concat(F.lit("["), F.concat_ws(",", decoded["payouts"]), F.lit("]")),
        ).alias("payouts"),
    ).agg(F.count(F.lit(1)).alias("logs"))


def links(spark, folder):
    rows = views.ladder(spark, folder)
    logit = numeric.platt_features("p", 1e-6)[0]
    low, high = numeric.beta_features("p", 1e-6)
    return rows.select(
        "event_id",
        "horizon_seconds",
        "threshold",
        F.round(logit, 9).alias("logit"),
        F.round(low, 9).alias("log_p"),
        F.round(high, 9).alias("neg_log_q"),
    )


def stable(spark, folder):
    """Sigmoid and softplus of account balances, far outside the range of a naive exponential."""
    rows = views.table(spark, folder, "customer")
    z = F.col("c_acctbal") / 10.0 - 400.0
    return rows.select(
        "c_custkey",
        F.round(numeric.sigmoid(z), 12).alias("sigmoid"),
        F.round(numeric.softplus(z), 9).alias("softplus"),
    )


def ratios(spark, folder):
    """Share of returned lines per supplier, with 0 where a part of the whole is empty."""
    lines = views.table(spark, folder, "lineitem")
    counts = lines.groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("part"),
        F.count(F.when(F.col("l_tax") > 0.07, 1)).alias("whole"),
    )
    ratio = numeric.safe_ratio("part", "whole")
    return counts.select(
        "l_suppkey",
        F.round(ratio, 9).alias("ratio"),
        numeric.ratio_matches(F.round(ratio, 6), "part", "whole").alias("six_digits_match"),
    )


def json_lists(spark, folder):
    """Property objects, arrays and damaged arrays of events."""
    rows = views.table(spark, folder, "events")
    shape = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit(",1]")))
        .otherwise(F.col("props"))
    )
    return rows.select("event_id", F.size(documents.json_list(shape)).alias("items"))


def labels(spark, folder):
    """Labels from a stated value and a price vector that may disagree or be missing."""
    rows = views.table(spark, folder, "lineitem")
    stated = (
        F.when(F.col("l_linestatus") == "O", "Yes")
        .when(F.col("l_tax") > 0.06, "0.0")
        .when(F.col("l_tax") > 0.04, "")
        .otherwise("no")
    )
    prices = (
        F.when(F.col("l_returnflag") == "A", '["1","0"]')
        .when(F.col("l_returnflag") == "N", '["0.0","1.0"]')
        .otherwise("")
    )
    label = documents.agreed_label(stated, prices)
    return rows.groupBy(stated.alias("stated"), prices.alias("prices"), label.alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def safe_paths(spark, folder):
    """Archive paths built from customers, some of them leaving their folder."""
    rows = views.table(spark, folder, "customer")
    path = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("raw/gamma/../"), "c_name", F.lit(".json.gz")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("/raw/gamma/"), "c_name", F.lit(".json.gz")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("raw/gamma//"), "c_name", F.lit(".json.gz")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("raw/gamma/"), "c_name", F.lit(".json")))
        .otherwise(F.concat(F.lit("raw/gamma/"), "c_name", F.lit(".json.gz")))
    )
    return rows.select(
        "c_custkey", documents.safe_archive_path(path, F.lit("gamma")).alias("safe")
    )


def digests(spark, folder):
    """Evidence digest of the order and customer digests of every order."""
    rows = views.table(spark, folder, "orders")
    log = F.sha2(F.col("o_orderkey").cast("string"), 256)
    block = F.sha2(F.col("o_custkey").cast("string"), 256)
    return rows.select("o_orderkey", chain.evidence_digest("", log, block).alias("digest"))


def column_names(spark, folder):
    """Every key in the event properties and part texts as a candidate feature name."""
    parts = views.table(spark, folder, "part").select(
        F.col("p_type").alias("table_name"),
        F.when(F.col("p_size") < 10, F.concat(F.lit("closedTime"), F.lit("")))
        .when(F.col("p_size") < 20, F.lit("final-volume"))
        .when(F.col("p_size") < 30, F.lit("__Best__Bid__"))
        .otherwise(F.concat(F.lit("feature"), F.initcap("p_name")))
        .alias("column_name"),
    )
    bad = quality.forbidden_columns(parts)
    return bad.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))


def column_sets(spark, folder):
    """Line numbers an order has against those its neighbours declare."""
    lines = views.table(spark, folder, "lineitem")
    named = lines.select(
        F.col("l_orderkey").cast("string").alias("table_name"),
        F.concat(F.lit("c"), "l_linenumber").alias("column_name"),
        "l_returnflag",
    )
    found = named.where("l_returnflag <> 'A'").select("table_name", "column_name")
    declared = named.where("l_returnflag <> 'R'").select("table_name", "column_name")
    return compare.column_differences(found, declared)


def whitelist(spark, folder):
    """Forecast columns without third-party free text."""
    rows = views.snapshot_text(spark, folder)
    kept = rows.select(*[c for c in rows.columns if c not in ("event_title", "question", "no_token")])
    return kept.select("event_id", "market_id", F.col("horizon_seconds").cast("bigint"), "threshold").withColumn(
        "columns", F.lit(len(kept.columns)).cast("bigint")
    )


_UNIT_SQL = (
    "case p_type when 'ECONOMY' then 1000e0 when 'SMALL' then 1000000e0 when 'STANDARD' then 0.01e0 "
    "when 'LARGE' then 0.0001e0 when 'MEDIUM' then 1000000000e0 else 1e0 end"
)
_CLIP = "greatest(1e-6, least(1 - 1e-6, p))"
_STATED = "case when l_linestatus = 'O' then 'Yes' when l_tax > 0.06 then '0.0' when l_tax > 0.04 then '' else 'no' end"
_PRICES = "case l_returnflag when 'A' then '[\"1\",\"0\"]' when 'N' then '[\"0.0\",\"1.0\"]' else '' end"
_EPOCH = "cast(epoch(o_orderdate) as bigint)"

QUERIES = {
    "fn1_threshold": (
        thresholds,
        f"select p_partkey, round(p_retailprice * {_UNIT_SQL}, 6) as price, cast(substr(p_brand, 7) as double) as brand, "
        "cast(null as double) as ambiguous, cast(null as double) as named from part",
    ),
    "fn2_timestamps": (
        timestamps,
        f"select o_orderkey, case when o_orderstatus = 'F' then {_EPOCH} end as strict, "
        f"case o_orderstatus when 'F' then {_EPOCH} when 'O' then {_EPOCH} - 7200 end as zoned, "
        "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as shown from orders",
    ),
    "fn3_whole_seconds": (
        whole_seconds,
        "select event_id, case when epoch_us(ts) // 500000 % 2 = 0 then epoch_us(ts) // 1000000 end as seconds from events",
    ),
    "fn4_daily_windows": (
        day_windows,
        "select o_custkey, date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 as windows, "
        "cast(epoch(min(o_orderdate)) as bigint) as first_start, "
        "cast(epoch(max(o_orderdate)) as bigint) + 3600 as last_end, "
        "cast(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) as bigint) + 3600 as covered from orders group by 1",
    ),
    "fn5_block_ranges": (
        block_ranges,
        "select l_orderkey, cast(sum(greatest(1, cast(ceil((b - l_partkey) / 999) as bigint))) as bigint) as ranges, "
        "min(l_partkey) as lowest, max(b) as highest, cast(sum(b - l_partkey) as bigint) as steps from "
        "(select *, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as b from lineitem) l "
        "where b >= l_partkey group by 1",
    ),
    "fn6_hex_values": (
        hex_values,
        "select o_orderkey, o_orderkey as quantity, cast(null as bigint) as padded, "
        "case when o_orderkey > 0 then (o_orderkey::hugeint * 1208925819614629174706176)::varchar end as wide, cast(null as varchar) as upper_prefix, "
        "'0x' || lpad(lower(to_hex(o_orderkey)), 64, '0') as id from orders",
    ),
    "fn7_payloads": (
        payloads,
        "select case when l_discount <> 0 and l_tax <> 0 then 2 end as slot_count, "
        "case when l_discount = 0 or l_tax = 0 then null when l_linestatus = 'O' then '[1,0]' else '[0,1]' end as payouts, "
        "count(*) as logs from lineitem group by 1, 2",
    ),
    "fn8_links": (
        links,
        sql.query(
            f"select event_id, horizon_seconds, threshold, round(ln({_CLIP}) - ln(1 - {_CLIP}), 9) as logit, "
            f"round(ln({_CLIP}), 9) as log_p, round(-ln(1 - {_CLIP}), 9) as neg_log_q from ladder",
            sql.LADDER,
        ),
    ),
    "fn9_stable_sigmoid": (
        stable,
        "select c_custkey, round(case when z >= 0 then 1 / (1 + exp(-z)) else exp(z) / (1 + exp(z)) end, 12) as sigmoid, "
        "round(greatest(z, 0) + ln(1 + exp(-abs(z))), 9) as softplus from "
        "(select c_custkey, c_acctbal / 10.0e0 - 400.0e0 as z from customer) c",
    ),
    "fn10_safe_ratio": (
        ratios,
        "select l_suppkey, round(r, 9) as ratio, abs(round(r, 6) - r) <= 1e-12 as six_digits_match from ("
        "select l_suppkey, case when count(case when l_tax > 0.07 then 1 end) = 0 then 0e0 else "
        "count(case when l_returnflag = 'R' then 1 end) / count(case when l_tax > 0.07 then 1 end) end as r "
        "from lineitem group by 1) x",
    ),
    "fn11_json_lists": (
        json_lists,
        "select event_id, case event_type when 'click' then 2 end as items from events",
    ),
    "fn12_labels": (
        labels,
        f"select stated, prices, case when stated = '' and prices = '' then null "
        "when stated = '' then p when prices = '' then s when s = p then s end as label, count(*) as n from ("
        f"select {_STATED} as stated, {_PRICES} as prices, "
        f"case ({_STATED}) when 'Yes' then 1e0 when '' then null else 0e0 end as s, "
        "case l_returnflag when 'A' then 1e0 when 'N' then 0e0 end as p from lineitem) x group by 1, 2, 3",
    ),
    "fn15_safe_paths": (
        safe_paths,
        "select c_custkey, c_mktsegment not in ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') as safe from customer",
    ),
    "fn16_evidence_digest": (
        digests,
        "select o_orderkey, sha256(unhex(sha256(cast(o_orderkey as varchar))) || "
        "unhex(sha256(cast(o_custkey as varchar)))) as digest from orders",
    ),
    "prj9_forbidden_columns": (
        column_names,
        "select p_type as table_name, case when p_size < 10 then 'closedTime' when p_size < 20 then 'final-volume' "
        "else '__Best__Bid__' end as column_name, count(*) as n from part where p_size < 30 group by 1, 2",
    ),
    "set1_column_sets": (
        column_sets,
        "with f as (select distinct cast(l_orderkey as varchar) as t, 'c' || l_linenumber as c from lineitem where l_returnflag <> 'A'), "
        "d as (select distinct cast(l_orderkey as varchar) as t, 'c' || l_linenumber as c from lineitem where l_returnflag <> 'R') "
        "select t as table_name, c as column_name, 'missing' as problem from (from d except from f) union all "
        "select t, c, 'unexpected' from (from f except from d)",
    ),
    "prj10_whitelist": (
        whitelist,
        "select cast(l_orderkey as varchar) as event_id, cast(l_orderkey * 10 + l_linenumber as varchar) as market_id, "
        "case when l_quantity = 11 then -horizon_seconds else horizon_seconds end as horizon_seconds, "
        "case when l_quantity = 4 then 'nan' else l_linenumber || '.0' end as threshold, 20 as columns "
        f"from lineitem join orders on o_orderkey = l_orderkey cross join {sql.HORIZONS}",
    ),
}
