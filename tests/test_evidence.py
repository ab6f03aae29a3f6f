"""An evidence table of metal prices: clean as built, and every spoilt cell fires its rule."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rungwise.config import Gate, Protocol
from rungwise.operators import quality
from rungwise.plans.evaluate import evaluate
from rungwise.sources import sinks, tables

WEEKS = {
    name: tuple(f"2031-02-{day:02d}T00:00:00Z" for day in (first, first + 7))
    for name, first in (("fit", 3), ("tune", 10), ("judge", 17))
}
METALS = ("Copper", "Tin", "Zinc")
HORIZONS = (3600, 600)
RUNGS = 5
PROTOCOL = Protocol(
    assets=METALS,
    splits=WEEKS,
    horizons=HORIZONS,
    training_split="fit",
    holdout_split="judge",
    minimum_thresholds=RUNGS,
    resolution_grace_seconds=900,
    resamples=60,
    seed=21,
    gate=Gate(minimum_events=6, minimum_blocks=3, maximum_log_regression=1.0),
)
#: Quotes along a ladder: the fourth rung is quoted above the third.
QUOTES = (0.92, 0.81, 0.55, 0.62, 0.13)


def stamp(moment):
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def sha(*parts):
    return hashlib.sha256("/".join(map(str, parts)).encode()).hexdigest()


def event_rows(week, number):
    """Both horizons of one event; the settled level passes ``number % 4 + 1`` rungs."""
    opened = datetime.fromisoformat(WEEKS[week][0]).astimezone(timezone.utc)
    settled = opened + timedelta(days=number, hours=5 * number % 24, minutes=15)
    event = f"{week[0]}{number}"
    for rung, quote in enumerate(QUOTES):
        passed = rung < number % 4 + 1
        name = f"{event}.{rung}"
        fixed = {
            "event_id": event, "market_id": name, "condition_id": "0x" + sha("condition", name),
            "asset": METALS[number % len(METALS)], "scheduled_time": stamp(settled),
            "utc_day": settled.date().isoformat(), "split": week, "threshold": str(12.5 + 2.5 * rung),
            "gamma_candidate_label": "Yes" if passed else "No", "yes_token": str(int(sha("token", name)[:12], 16)),
            "reference_probability": str(quote), "source_event_sha256": sha("event", event),
            "source_history_sha256": sha("history", name), "event_horizon_contract_count": str(RUNGS),
            "label": "1.0" if passed else "0.0", "payout_vector": "[1,0]" if passed else "[0,1]",
            "resolution_block_number": str(880 + number), "resolution_block_hash": "0x" + sha("block", number),
            "resolution_block_timestamp": stamp(settled + timedelta(minutes=4)),
            "resolution_tx_hash": "0x" + sha("transaction", name), "resolution_log_index": str(3 * rung + 2),
            "chain_source_sha256": sha("chain", event),
        }
        for horizon in HORIZONS:
            asked = settled - timedelta(seconds=horizon)
            yield fixed | {
                "horizon_seconds": str(horizon), "cutoff_time": stamp(asked),
                "reference_timestamp": stamp(asked - timedelta(seconds=11)), "staleness_seconds": "11",
            }


def cells():
    return [row for week in WEEKS for number in range(6) for row in event_rows(week, number)]


def frame(spark, rows):
    schema = ", ".join(f"{c} string" for c in tables.EVIDENCE_COLUMNS)
    data = [tuple(r[c] for c in tables.EVIDENCE_COLUMNS) for r in rows]
    return tables.typed_table(spark.createDataFrame(data, schema), tables.EVIDENCE_COLUMNS)


def rules(df):
    return {r.rule_id for r in df.collect()}


def everything(df):
    return (
        quality.evidence_row_violations(df)
        .unionByName(quality.table_invariants(df, chain=True))
        .unionByName(quality.protocol_violations(df, PROTOCOL, chain=True))
    )


def test_clean_table(spark):
    quality.assert_clean(everything(frame(spark, cells())))


#: rule -> a cell of the first row (event f0, week fit, rung 0, passed, horizon 3600) that breaks it.
SPOILT = {
    "label_payout_disagreement": ("payout_vector", "[0,1]"),
    "label_candidate_disagreement": ("gamma_candidate_label", "No"),
    "non_binary_label": ("label", "0.25"),
    "bad_timestamp": ("reference_timestamp", "yesterday"),
    "non_finite_threshold": ("threshold", "inf"),
    "probability_outside_unit_interval": ("reference_probability", "-0.01"),
    "non_positive_horizon": ("horizon_seconds", "-600"),
    "negative_staleness": ("staleness_seconds", "-5"),
    "non_positive_contract_count": ("event_horizon_contract_count", "-2"),
    "negative_chain_coordinate": ("resolution_log_index", "-7"),
    "empty_identifier": ("market_id", ""),
    "non_decimal_yes_token": ("yes_token", "12.0"),
    "bad_source_event_digest": ("source_event_sha256", sha("event", "f0").upper()),
    "bad_source_history_digest": ("source_history_sha256", "none"),
    "bad_chain_source_digest": ("chain_source_sha256", sha("x")[:63]),
    "bad_condition_id": ("condition_id", sha("no prefix")),
    "bad_block_hash": ("resolution_block_hash", "0x" + "g" * 64),
    "bad_transaction_hash": ("resolution_tx_hash", "0x"),
    "utc_day_differs": ("utc_day", "2031-02-04"),
    "cutoff_differs": ("cutoff_time", "2031-02-02T23:15:30Z"),
    "future_reference_point": ("reference_timestamp", "2031-02-02T23:59:00Z"),
    "staleness_differs": ("staleness_seconds", "12"),
    "staleness_above_limit": ("reference_timestamp", "2031-02-02T22:00:00Z"),
    "ladder_below_minimum": ("event_horizon_contract_count", "4"),
    "contract_count_differs": ("event_horizon_contract_count", "6"),
    "undeclared_split": ("split", "spare"),
    "undeclared_asset": ("asset", "Lead"),
    "undeclared_horizon": ("horizon_seconds", "3601"),
    "scheduled_outside_split": ("scheduled_time", "2031-02-10T00:00:00Z"),
    "resolution_outside_grace": ("resolution_block_timestamp", "2031-02-03T00:30:01Z"),
    "event_properties_disagree": ("source_event_sha256", sha("other event")),
    "market_properties_disagree": ("source_history_sha256", sha("other history")),
    "chain_evidence_disagrees": ("resolution_block_number", "881"),
    "duplicate_threshold": ("threshold", "15.0"),
    "market_in_several_events": ("market_id", "t0.3"),
}


@pytest.mark.parametrize("rule", SPOILT)
def test_one_spoilt_cell(spark, rule):
    rows = cells()
    field, value = SPOILT[rule]
    rows[0][field] = value
    assert rule in rules(everything(frame(spark, rows)))


def test_table_level_faults(spark):
    rows = cells()
    assert "duplicate_row" in rules(quality.table_invariants(frame(spark, rows + rows[:1])))
    assert "ladder_differs_across_horizons" in rules(quality.table_invariants(frame(spark, rows[1:])))
    for row in rows:
        if row["event_id"] == "j3":
            row["label"] = str(1.0 - float(row["label"]))
    assert "labels_rise_along_ladder" in rules(quality.table_invariants(frame(spark, rows)))


def test_leakage_limits(spark):
    df = spark.sql(
        "select 'k' as k, timestamp'2026-06-01 00:00:00' as at, timestamp'2026-06-01 00:00:00.000001' as later"
    )
    key = F.col("k")
    assert quality.late_features(df, "at", "at", 0, key).count() == 0
    assert quality.late_features(df, "later", "at", 0, key).count() == 1
    assert quality.late_features(df, "at", "at", 1, key).count() == 1
    assert quality.late_labels(df, "at", "at", 0, key).count() == 1
    assert quality.late_labels(df, "at", "later", 0, key).count() == 0
    with pytest.raises(ValueError):
        quality.late_labels(df, "at", "at", -1, key)


def test_round_trip_through_the_sink(spark, tmp_path):
    df = frame(spark, cells())
    sinks.write_evidence(df, WEEKS, str(tmp_path / "out"))
    back = tables.scan_evidence(spark, str(tmp_path / "out"))
    assert back.exceptAll(df).count() == 0 and back.count() == len(cells())
    with pytest.raises(tables.SchemaError, match="missing"):
        tables.typed_table(df.drop("label"), tables.EVIDENCE_COLUMNS)
    with pytest.raises(tables.SchemaError, match="unexpected"):
        tables.typed_table(df.withColumn("x", F.lit(1)), tables.EVIDENCE_COLUMNS)


def test_full_evaluation(spark):
    rows = frame(spark, cells()).select(
        "event_id", "horizon_seconds", "threshold", F.col("reference_probability").alias("p"), "label", "split",
        F.col("utc_day").alias("block"), "asset",
    )
    cover = spark.createDataFrame(
        [("judge", 3600, 1.0, 1.0)], "split string, horizon_seconds long, event_coverage double, row_coverage double"
    )
    done = evaluate(rows, PROTOCOL, cover)
    metrics = {(r.split, r.horizon_seconds, r.method): r for r in done.metrics.collect()}
    assert len(metrics) == 30
    assert metrics["judge", 3600, "raw"].edges == 6 and metrics["judge", 3600, "raw"].violating_events == 6
    assert metrics["judge", 3600, "pav_raw"].edges == metrics["judge", 600, "pav_beta"].edges == 0
    primary = done.comparisons.where("split = 'judge' and horizon_seconds = 3600 and comparison = 'pav_raw_vs_raw'").first()
    assert primary.brier_delta > 0
    gate = done.gate.collect()
    assert len([r for r in gate if r.gate == "primary"]) == 9
    assert all(r.passed for r in gate if r.gate == "primary"), [r for r in gate if not r.passed]
    assert {m.iterations for m in done.models} <= set(range(1, 15))
    document = sinks.result_document(done.summary, done.metrics, done.comparisons, done.gate.where("gate = 'primary'"))
    assert '"passed":true' in document.first().value


def test_record_fields_are_a_closed_set(spark):
    import json

    from rungwise.sources import provenance

    good = {n: "x" for n in provenance.RECORD_FIELDS[""]} | {"request": {"method": "GET", "url": "u"}}
    extra = good | {"path": "b", "note": "n"}
    odd = good | {"path": "c", "request": {"url": "u", "proxy": "p", "body": "", "body_sha256": ""}}
    short = {k: v for k, v in good.items() if k != "gzip_bytes"} | {"path": "d"}
    text = json.dumps({"raw_responses": [good, extra, odd, short]})
    found = provenance.record_field_problems(spark.createDataFrame([(text,)], "body string")).collect()
    assert {tuple(r) for r in found} == {
        ("unexpected_field", "b", "note"),
        ("unexpected_field", "c", "request.proxy"),
        ("missing_field", "c", "request.method"),
        ("missing_field", "d", "gzip_bytes"),
    }


def test_only_known_methods_may_be_logged(spark):
    from rungwise.sources import provenance

    rows = [(m,) for m in (*provenance.METHODS, "eth_call", "eth_call", None)]
    found = provenance.method_problems(spark.createDataFrame(rows, "method string")).collect()
    assert {tuple(r) for r in found} == {("method_not_allowed", "eth_call", "2 responses"), ("method_not_allowed", "", "1 responses")}


def test_key_rules_in_one_aggregate(spark):
    """Any number of rules is one scan and one shuffle; nulls, zeros and NaN keys are told apart."""
    rows = [
        ("a", 1, 0.0, None), ("a", 1, -0.0, None), ("b", 2, float("nan"), "x"), ("b", 3, float("nan"), "x"),
        (None, 4, 1.0, ""), ("", 4, 1.0, ""), ("c", 5, 2.0, None), ("c", 5, 2.0, ""), ("d|e", 6, 3.0, "f"), ("d", 6, 3.0, "e|f"),
    ]
    df = spark.createDataFrame(rows, "k string, v int, t double, s string")
    rules_ = [
        quality.KeyRule("k_v", ("k",), ("v",)),
        quality.KeyRule("k_s", ("k",), ("s",)),
        quality.KeyRule("t_once", ("t",), once=True),
        quality.KeyRule("k_s_once", ("k", "s"), once=True),
    ]
    got = quality.key_violations(df, rules_)
    assert {tuple(r) for r in got.collect()} == {
        ("k_v", "b", ""), ("k_s", "c", ""), ("t_once", "0.0", "2"), ("t_once", "NaN", "2"), ("t_once", "1.0", "2"),
        ("t_once", "2.0", "2"), ("t_once", "3.0", "2"), ("k_s_once", "a", "2"), ("k_s_once", "b|x", "2"),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Generate") <= 1
    assert quality.key_violations(df.limit(0), rules_).count() == 0


def test_row_rules_are_compiled(spark):
    """No lambda stands around the rules, and one violation row comes of each broken rule."""
    rows = spark.createDataFrame([(1, 2), (None, 2), (1, 0)], "a int, b int")
    found = quality.row_rules(rows, {"a": F.col("a") != 1, "b": F.col("b") <= 0}, F.lit("k"))
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.rule_id for r in found.collect()) == ["a", "b"]


def test_determined_fields_are_written_as_digests_and_keys_move_without_text(spark):
    df = spark.createDataFrame([("e", "m", 900, 1.0, 0.0, "x" * 200), ("e", "m", 900, 1.0, 0.0, "y" * 200)],
                               "event_id string, market_id string, horizon_seconds int, threshold double, label double, wide string")
    rules_ = [quality.KeyRule("d", ("event_id", "market_id"), ("wide",)), quality.KeyRule("r", ("event_id",), rising=("threshold", "label"))]
    facts = quality.key_facts(df, rules_, ("horizon_seconds",))
    assert "wide" not in facts.columns and dict(facts.dtypes)["_content_0"] == "bigint"
    assert [tuple(r) for r in quality.broken_keys(facts, rules_).collect()] == [("d", "e|m", "")]
