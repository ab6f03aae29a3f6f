from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from rungwise.config import Protocol
from rungwise.operators import coverage, labels
from rungwise.plans.verify import verify_labels

DAY = datetime(2026, 6, 1)
TARGET = DAY + timedelta(hours=1)
PROTOCOL = Protocol(assets=("A",), splits={}, resolution_grace_seconds=3 * 3600)
LOGS = (
    "condition_id string, block_number long, block_hash string, tx_hash string, log_index long, "
    "removed boolean, slot_count long, payouts array<long>"
)
CANDIDATES = "event_id string, condition_id string, split string, horizon_seconds long, target_at timestamp, candidate double"


def log(condition, payout, block=2, index=0, tx="t", removed=False, hash_="h"):
    slots = None if payout is None else len(payout)
    return (condition, block, f"{hash_}{block}", tx, index, removed, slots, payout)


def blocks(spark):
    at = [-1, 0, 1.5, 4, 5, 24, 27]
    rows = [(i, f"h{i}", DAY + timedelta(hours=h)) for i, h in enumerate(at)]
    return spark.createDataFrame(rows, "number long, hash string, ts timestamp")


def candidates(spark, rows):
    data = [(e, c, "dev", h, TARGET, y) for e, c, y in rows for h in (1800, 900)]
    return spark.createDataFrame(data, CANDIDATES)


def run(spark, rows, logs, expected=(4, 10, 2, 3)):
    names = "expected_events long, expected_rows long, history_retained_events long, history_retained_rows long"
    pre = spark.createDataFrame([("dev", h, *expected) for h in (1800, 900)], f"split string, horizon_seconds long, {names}")
    return verify_labels(candidates(spark, rows), spark.createDataFrame(logs, LOGS), blocks(spark), pre, PROTOCOL)


def statuses(done):
    return {r.condition_id: (r.status, r.reason) for r in done.resolutions.collect()}


def test_incomplete_events_are_dropped_and_counted(spark):
    rows = [("good", "c1", 1.0), ("good", "c2", 0.0), ("gone", "c3", 1.0)]
    done = run(spark, rows, [log("c1", [1, 0]), log("c1", [1, 0]), log("c2", [0, 1], block=3)])
    assert {c: s for c, (s, _) in statuses(done).items()} == {"c1": "agreed", "c2": "agreed", "c3": "missing"}
    assert {r.event_id for r in done.retained.collect()} == {"good"} and done.retained.count() == 4
    cell = done.coverage.where("horizon_seconds = 1800").first()
    assert (cell.retained_events, cell.retained_rows) == (1, 2)
    assert (cell.event_coverage, cell.row_coverage) == (0.25, 0.2)
    assert cell.row_chain_given_history_coverage == pytest.approx(2 / 3)


@pytest.mark.parametrize(
    ("logs", "status", "reason"),
    [
        ([log("c", [1, 1])], "ambiguous", "unsupported payout vector [1, 1]"),
        ([log("c", [1, 0]), log("c", [1, 0], index=1)], "ambiguous", "found 2 distinct ConditionResolution logs"),
        ([log("c", [0, 1])], "gamma_disagreement", labels.DISAGREED),
        ([log("c", [1, 0], removed=True)], "ambiguous", labels.REMOVED),
        ([log("c", [1, 0], removed=None)], "ambiguous", labels.REMOVED),
        ([log("c", None)], "ambiguous", "invalid ConditionResolution ABI"),
        ([log("c", [1, 0, 0])], "ambiguous", "unsupported payout vector [1, 0, 0]"),
        ([log("c", [1, 0], block=1)], "ambiguous", labels.EARLY),
        ([log("c", [1, 0], block=3)], "agreed", labels.AGREED),
        ([log("c", [1, 0], block=4)], "ambiguous", labels.LATE),
        ([log("c", [1, 0], block=6)], "missing", labels.MISSING),
        ([log("c", [1, 0], block=0)], "missing", labels.MISSING),
    ],
)
def test_classification(spark, logs, status, reason):
    assert statuses(run(spark, [("e", "c", 1.0)], logs))["c"] == (status, reason)


def test_conflicts_are_fatal(spark):
    with pytest.raises(Exception, match="conflicting duplicate log"):
        run(spark, [("e", "c", 1.0)], [log("c", [1, 0]), log("c", [0, 1])])
    with pytest.raises(Exception, match="hash mismatch"):
        run(spark, [("e", "c", 1.0)], [log("c", [1, 0], hash_="x")])
    with pytest.raises(AssertionError, match="conflicting candidate metadata"):
        run(spark, [("e", "c", 1.0), ("e", "c", 0.0)], [])


def test_logs_of_unknown_blocks_are_never_lost(spark):
    rows, unknown = [("e", "c", 1.0)], [log("c", [1, 0], block=99)]
    with pytest.raises(AssertionError, match="not in the block table"):
        run(spark, rows, unknown)
    logs, known = spark.createDataFrame(unknown * 3, LOGS), blocks(spark)
    assert [tuple(r) for r in labels.unknown_blocks(logs, known).collect()] == [("block_unknown", "99", "3 logs")]
    unique = labels.attach_blocks(labels.distinct_logs(logs, ("condition_id", "block_hash", "tx_hash", "log_index")), known)
    conditions = candidates(spark, rows).where("horizon_seconds = 900")
    kept = labels.logs_in_window(unique, conditions.select("condition_id", "target_at"), 3 * 3600)
    found = labels.classify(conditions, kept, 3 * 3600).first()
    assert (found.status, found.reason) == ("ambiguous", labels.UNKNOWN_BLOCK)


def test_agreed_conditions_carry_what_they_cite(spark):
    done = run(spark, [("e", "c", 1.0), ("f", "d", 0.0)], [log("c", [1, 0], block=3, index=7, tx="t9"), log("d", [1, 0])])
    cited = {r.condition_id: r for r in done.rows.collect()}
    r = cited["c"]
    assert r.payout_vector == [1, 0] and (r.resolution_block_number, r.resolution_block_hash) == (3, "h3")
    assert (r.resolution_tx_hash, r.resolution_log_index) == ("t9", 7)
    assert r.resolution_block_timestamp == DAY + timedelta(hours=4)
    assert cited["d"].status == "gamma_disagreement" and cited["d"].payout_vector is None


def test_window_summary_is_clamped_to_the_head(spark):
    conditions = candidates(spark, [("e", "c", 1.0)]).where("horizon_seconds = 900")
    row = labels.search_summary(conditions, blocks(spark), 3 * 3600, 2).first()
    assert (row.clamped, row.from_block, row.to_block, row.ranges) == (False, 1, 5, 4)
    row = labels.search_summary(conditions, blocks(spark), 9 * 3600, 3).first()
    assert (row.clamped, row.to_block, row.ranges) == (True, 6, 3)


def test_status_algebra(spark):
    done = run(spark, [("a", "c1", 1.0), ("b", "c2", 1.0)], [log("c1", [1, 0])])
    row = coverage.status_algebra(done.resolutions, done.rows, done.retained).first()
    assert (row.conditions_agreed, row.conditions_missing, row.retained_rows) == (1, 1, 2)
    assert row.retained_within_agreed and not row.all_verified
    counts = {r.status: r.n for r in coverage.status_counts(done.resolutions).collect()}
    assert counts == {"agreed": 1, "missing": 1, "ambiguous": 0, "gamma_disagreement": 0}


def test_coverage_reconciliation_names_each_difference(spark):
    names = ("split string, horizon_seconds long, expected_events long, expected_rows long, "
             "history_retained_events long, history_retained_rows long, event_history_coverage double, row_history_coverage double")
    good = ("dev", 900, 4, 10, 2, 5, 0.5, 0.5)
    found = spark.createDataFrame([good], names)
    assert coverage.reconcile(found, found).count() == 0
    wrong = spark.createDataFrame([("dev", 900, 4, 10, 5, 5, 0.5, 0.6), ("x", 900, 0, 0, 0, 0, 0.0, 0.0)], names)
    rules = {(r.split, r.rule) for r in coverage.reconcile(wrong, found).collect()}
    assert rules == {
        ("dev", "count_history_retained_events"),
        ("dev", "nested_history_retained_events"),
        ("dev", "ratio_event_history_coverage"),
        ("dev", "ratio_row_history_coverage"),
        ("x", "cell_not_found"),
    }
