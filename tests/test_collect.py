"""Selection and collection on invented river-level ladders."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rungwise.config import Protocol
from rungwise.operators import select
from rungwise.operators.quality import DataQualityError
from rungwise.plans.collect import build_snapshot, deduplicated_events, selected_pages, snapshot_of
from rungwise.sources import nested
from rungwise.workload import views

CLOSE_TEXT = "2031-03-05T06:00:00Z"
CLOSE = int(datetime(2031, 3, 5, 6, tzinfo=timezone.utc).timestamp())
NAME = "Elbe above ___ on the morning of 5 March?"
PROTOCOL = Protocol(
    assets=("Elbe", "Rhine"),
    splits={"spring": ("2031-03-01T00:00:00Z", "2031-04-01T00:00:00Z")},
    title_regex=r"^(Elbe|Rhine) above ___ on the (morning|evening) of .+\?$",
    discovery=("2031-03-01T00:00:00Z", "2031-04-01T00:00:00Z"),
    minimum_thresholds=2,
    max_staleness_seconds=120,
)


def rung(level, won, **changes):
    """One contract of the ladder at ``level`` centimetres; its id and tokens follow from it."""
    out = {name: f"{name}-{level}" for name in ("id", "conditionId")}
    out["question"], out["groupItemTitle"] = NAME.replace("___", str(level)), str(level)
    out["endDate"], out["closed"], out["enableOrderBook"] = CLOSE_TEXT, True, True
    out["umaResolutionStatus"], out["outcomes"] = "resolved", '["Yes","No"]'
    out["outcomePrices"] = '["1","0"]' if won else '["0","1"]'
    out["clobTokenIds"] = json.dumps([f"{level}7", f"{level}8"])
    return {**out, **changes}


def ladder(name, *rungs, **changes):
    return {"id": name, "title": NAME, "endDate": CLOSE_TEXT, "closed": True, "markets": list(rungs), **changes}


def sound(**changes):
    return ladder("sound", rung(310, True), rung(340, False), **changes)


def spoilt():
    """One contract without a terminal price, one whose question names another level."""
    return ladder("spoilt", rung(355, True, outcomePrices='["0.4","0.6"]'), rung(380, True, question=NAME.replace("___", "381")))


def landed(spark, *windows):
    return nested.event_pages(
        spark.createDataFrame([(n, json.dumps({"events": w})) for n, w in enumerate(windows)], "window int, body string")
    )


def quotes(spark, **series):
    """Each argument is a token's list of (seconds before the close, price)."""
    body = {"history": {k.lstrip("t"): [{"t": CLOSE - ago, "p": p} for ago, p in v] for k, v in series.items()}}
    return nested.history_points(spark.createDataFrame([(json.dumps(body),)], "body string"))


# Ages at the two cutoffs: 60 and 120 seconds are fresh enough, 121 is not; later points do not count.
FRESH = {"t3107": [(1860, "0.81"), (1799, "0.02"), (1020, "0.77"), (899, "0.03")], "t3407": [(1800, 0.25), (900, 0.35)]}


def test_from_overlapping_windows_to_rows(spark):
    first, second = [sound(), spoilt()], [sound(volume=9), {**spoilt(), "volume": 12}]
    unique = deduplicated_events(landed(spark, first, second), ["window", "position"])
    done = build_snapshot(unique, quotes(spark, **FRESH), PROTOCOL, "gauges")
    rows = done.rows.collect()
    assert {(r.yes_token, r.horizon_seconds, r.staleness_seconds, r.reference_probability) for r in rows} == {
        ("3107", 1800, 60, 0.81), ("3107", 900, 120, 0.77), ("3407", 1800, 0, 0.25), ("3407", 900, 0, 0.35),
    }
    assert {r.event_id for r in rows} == {"sound"}
    for cell in done.coverage.collect():
        assert (cell.expected_events, cell.history_retained_rows, cell.row_history_coverage) == (1, 2, 1.0)
    judged = [x for r in select.market_decisions(done.selected).collect() for x in r.reasons]
    assert sorted(judged) == ["non_terminal_gamma_outcome_prices", "question_does_not_match_event_template"]


def test_a_token_in_two_history_documents_is_an_error(spark):
    both = quotes(spark, **FRESH).unionByName(quotes(spark, t3107=[(2000, 0.5)]))
    with pytest.raises(DataQualityError, match="3107 has a history in several"):
        build_snapshot(landed(spark, [sound()]), both, PROTOCOL, "gauges")


def test_only_changes_that_matter_are_fatal(spark):
    turned = dict(sorted(sound().items(), reverse=True))
    shown = landed(spark, [sound()], [sound(volume=1)], [turned]).select(
        "id", "window", select.selection_fingerprint().alias("selection"), F.sha2("canonical", 256).alias("full"), F.lit(1).alias("payload")
    )
    row = select.first_seen(shown, ["window"]).first()
    assert (row.duplicates, row.unused_field_changes, row.changed) == (2, 1, False)
    with pytest.raises(Exception, match="changed selection-relevant"):
        deduplicated_events(landed(spark, [sound()], [sound(closed=False)]), ["window"]).collect()


@pytest.mark.parametrize(
    ("late", "reason"),
    [
        ([(1921, 0.25), (900, 0.35)], "latest_point_exceeds_max_staleness"),
        ([(900, 0.35)], "no_point_at_or_before_cutoff"),
        ([(1810, 0.25), (1810, 0.26), (900, 0.35)], "conflicting_probabilities_at_one_timestamp"),
    ],
)
def test_one_bad_series_drops_the_curve(spark, late, reason):
    done = build_snapshot(landed(spark, [sound()]), quotes(spark, t3107=FRESH["t3107"], t3407=late), PROTOCOL, "gauges")
    horizons = {900} if "conflict" not in reason else set()
    assert {r.horizon_seconds for r in done.rows.collect()} == horizons
    assert {r.reason for r in done.decisions.collect() if r.status == "rejected"} == {reason}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"title": None}, "missing_event_title"),
        ({"title": NAME.replace("Elbe", "Oder")}, "event_title_regex_mismatch,asset_not_allowed"),
        ({"closed": False}, "event_not_closed"),
        ({"endDate": CLOSE_TEXT.rstrip("Z")}, "invalid_event_end_date"),
        ({"endDate": "2031-04-01T00:00:00Z"}, "event_outside_discovery_half_open_interval,event_not_in_any_split"),
        ({"markets": None}, "missing_nested_markets"),
        ({"markets": []}, "too_few_strictly_eligible_markets"),
    ],
)
def test_event_reasons(spark, change, reason):
    (row,) = select.select_events(landed(spark, [sound(**change)]), PROTOCOL).collect()
    assert (",".join(row.reasons), row.status) == (reason, "rejected")


MARKET_FAULTS = {
    "missing_market_id": {"id": ""},
    "missing_condition_id": {"conditionId": "  "},
    "missing_group_item_title,question_does_not_match_event_template": {"groupItemTitle": None},
    "market_not_closed": {"closed": "true"},
    "order_book_not_enabled": {"enableOrderBook": None},
    "resolution_status_mismatch": {"umaResolutionStatus": "open"},
    "market_end_does_not_match_event_end": {"endDate": "2031-03-05T06:00:01Z"},
    "invalid_market_end_date": {"endDate": "tomorrow"},
    "outcomes_mismatch": {"outcomes": '["No","Yes"]'},
    "invalid_outcomes": {"outcomes": "either"},
    "invalid_outcome_prices": {"outcomePrices": '["1","0","0"]'},
    "invalid_clob_token_ids": {"clobTokenIds": '["9","9"]'},
}
SAME_REASON = [{"outcomePrices": "[true, 0]"}, {"outcomePrices": '["nan","0"]'}]
NO_FAULT = [{"clobTokenIds": ["3107", "3108"]}, {"outcomePrices": [1, 0]}]


@pytest.mark.parametrize(
    ("change", "reason"),
    [(c, r) for r, c in MARKET_FAULTS.items()] + [(c, "invalid_outcome_prices") for c in SAME_REASON] + [(c, "") for c in NO_FAULT],
)
def test_market_reasons(spark, change, reason):
    chosen = select.select_events(landed(spark, [ladder("one", rung(310, True, **change), rung(340, False))]), PROTOCOL)
    assert ",".join(select.market_decisions(chosen).first().reasons) == reason
    assert chosen.first().status == ("rejected" if reason else "selected")


def test_copies_inside_and_across_events(spark):
    (row,) = select.select_events(landed(spark, [ladder("twins", rung(310, True), rung(310, True))]), PROTOCOL).collect()
    assert row.reasons == [f"duplicate_{what}_after_market_filter" for what in ("thresholds", "market_ids", "token_ids")]
    with pytest.raises(DataQualityError, match="market id appeared"):
        build_snapshot(landed(spark, [sound(), sound(id="again")]), quotes(spark, **FRESH), PROTOCOL, "gauges")


@pytest.mark.parametrize(
    ("point", "problem"),
    [
        ({"t": False, "p": 0.1}, "boolean_data"),
        ({"t": 7, "p": True}, "boolean_data"),
        ({"t": 7.25, "p": 0.1}, "timestamp_not_integral"),
        ({"t": 7, "p": "high"}, "invalid_t_or_p"),
        ({"p": 0.1}, "invalid_t_or_p"),
        ({"t": 7, "p": -0.1}, "out_of_range"),
        ({"t": "7", "p": "0"}, None),
    ],
)
def test_history_points(spark, point, problem):
    text = json.dumps({"history": {"token": [point]}})
    assert nested.history_points(spark.createDataFrame([(text,)], "body string")).first().problem == problem


def test_flat_documents_prefer_market_fields(spark):
    text = json.dumps({"events": [{"id": "outer", "split": "spring", "markets": [{"id": "inner", "x": 4}]}]})
    shape = "events array<struct<id:string, split:string, markets:array<struct<id:string, x:int>>>>"
    df = spark.createDataFrame([(text,)], "v string").select(F.from_json("v", shape).alias("d")).select("d.*")
    assert nested.flatten_candidates(df).first().asDict() == {"split": "spring", "id": "inner", "x": 4}


def test_request_batches_are_bounded(spark):
    rows = [("a", f"t{i}", i) for i in range(33)] + [("b", "t", 0)]
    asked = spark.createDataFrame(rows, "event string, token string, rung int").withColumn("end", F.timestamp_seconds(F.lit(CLOSE)))
    for limit in (1_000, 5):
        plan = select.request_batches(asked, "event", "token", "rung", "end", 600, size=15, max_rows=limit).collect()
        assert sorted((r.event, r.batch_index, len(r.tokens)) for r in plan) == [("a", 0, 15), ("a", 1, 15), ("a", 2, 3), ("b", 0, 1)]
        assert {(r.start_ts, r.end_ts) for r in plan} == {(CLOSE - 600, CLOSE)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_event_is_parsed_once_however_many_fields_are_read(spark):
    pages = landed(spark, [sound()]).select(select.event_reasons(PROTOCOL, F.to_timestamp("endDate")).alias("r"))
    optimised = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline(array(from_json" in optimised


def test_copies_of_pages_meet_in_one_shuffle_with_the_fields_asked_for(spark):
    pages = landed(spark, [sound(), spoilt()], [sound(volume=9)])
    counted = deduplicated_events(pages, ["window", "position"], ["id", F.size("markets").alias("n")])
    plan = _plan(counted)
    assert plan.count("Exchange hashpartitioning") == 1 and "parse_json" not in plan
    assert sorted(map(tuple, counted.collect())) == [("sound", 2), ("spoilt", 2)]


def test_events_decided_page_by_page_are_those_decided_after_copies_met(spark):
    pages = landed(spark, [sound(), spoilt()], [sound(volume=9), ladder("open", rung(1, True), closed=False)])
    order = ["window", "position"]
    one = selected_pages(pages, order, PROTOCOL)
    two = select.select_events(deduplicated_events(pages, order), PROTOCOL)
    shared = [c for c in one.columns if c != "candidates"]
    assert sorted(map(str, one.select(shared).collect())) == sorted(map(str, two.select(shared).collect()))
    assert sorted(map(str, select.contracts(one).collect())) == sorted(map(str, select.contracts(two).collect()))
    done = snapshot_of(one, quotes(spark, **FRESH), PROTOCOL, "gauges")
    assert {(r.event_id, r.yes_token, r.horizon_seconds) for r in done.rows.collect()} == {
        ("sound", t, h) for t in ("3107", "3407") for h in (1800, 900)
    }
    with pytest.raises(Exception, match="changed selection-relevant"):
        selected_pages(landed(spark, [sound()], [sound(closed=False)]), ["window"], PROTOCOL).collect()


def test_documents_meet_as_narrow_rows(spark):
    """No shuffle carries the text of a market."""
    plan = views.event_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "conditionId" not in below and "to_json" not in below


def test_documents_are_made_by_tasks_of_bounded_rows(spark, monkeypatch):
    """Tasks follow the rows, not the moved bytes; lines and orders are moved once."""
    small = "/root/testdata/sf0.001"
    rows = sum(views.table(spark, small, t).count() for t in ("lineitem", "orders"))
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    documents = views.event_documents(spark, small)
    assert _plan(documents).count("Exchange hashpartitioning") == 2
    assert documents.rdd.getNumPartitions() == -(-rows // 300) > 8


def test_documents_of_both_windows_are_made_once(spark):
    rows = views.overlapping_pages(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # lines and orders, each read once


def test_cutoff_rows_meet_contracts_by_token(spark):
    from rungwise.operators import asof

    contracts = select.contracts(select.select_events(landed(spark, [sound(), spoilt()]), PROTOCOL))
    points = quotes(spark, **FRESH).select("token", "ts", "p")
    limits = (PROTOCOL.horizons, PROTOCOL.max_staleness_seconds)
    names = ["market_id", "horizon_seconds", "cutoff", "utc_day", "status", "reason", "p", "point_ts", "staleness_seconds"]
    one = asof.cutoff_rows(contracts, points, *limits).select(*names)
    other = asof.cutoff_rows_of_tokens(contracts, contracts.select("token", "event_end"), points, *limits)
    found = other.select(*names).collect()
    assert len(found) == 4 and sorted(map(str, found)) == sorted(map(str, one.collect()))
