from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from rungwise.operators import asof

BASE = datetime(2026, 6, 2)
POINTS = "token string, ts timestamp, p double"
CUTS = "token string, cutoff timestamp"


def decide(spark, points, cutoff, limit, **kw):
    p = spark.createDataFrame([("a", t, v) for t, v in points], POINTS)
    c = spark.createDataFrame([("a", cutoff)], CUTS)
    return asof.asof_decisions(p, c, limit, **kw).first()


def hours(h):
    return BASE + timedelta(hours=h)


def test_equal_copies_at_the_cutoff_are_fine(spark):
    got = decide(spark, [(hours(-1), 0.1), (hours(2), 0.3), (hours(3), 0.4), (hours(3), 0.4)], hours(3), 0)
    assert (got.status, got.p, got.staleness_seconds) == ("selected", 0.4, 0)


def test_future_points_are_ignored(spark):
    got = decide(spark, [(hours(1), 0.2), (hours(4), 0.9)], hours(3), 7200)
    assert got.p == 0.2
    assert decide(spark, [(hours(4), 0.9)], hours(3), 7200).reason == asof.NO_POINT


def test_conflict_outranks_everything_even_when_old(spark):
    points = [(hours(-40), 0.1), (hours(-40), 0.2), (hours(3), 0.4)]
    assert decide(spark, points, hours(3), 60).reason == asof.CONFLICT
    later = [(hours(4), 0.1), (hours(4), 0.2), (hours(3), 0.4)]
    assert decide(spark, later, hours(3), 60).status == "selected"


@pytest.mark.parametrize(("age", "status"), [(120, "selected"), (121, "rejected")])
def test_staleness_equality(spark, age, status):
    got = decide(spark, [(BASE - timedelta(seconds=age), 0.3)], BASE, 120)
    assert got.status == status
    assert got.reason == (None if status == "selected" else asof.STALE)


def test_negative_staleness_is_refused(spark):
    with pytest.raises(ValueError):
        decide(spark, [], BASE, -1)


@pytest.mark.parametrize("bucket", [60, 3_600, 86_400 * 30])
def test_against_brute_force_for_any_bucket(spark, bucket):
    rng = np.random.default_rng(6)
    points, cutoffs = [], []
    for token in "abcd":
        for s in rng.integers(0, 20_000, 60):
            points.append((token, BASE + timedelta(seconds=int(s)), float(rng.integers(0, 50)) / 50))
        for s in rng.integers(0, 22_000, 40):
            cutoffs.append((token, BASE + timedelta(seconds=int(s))))
    limit = 400
    p, c = spark.createDataFrame(points, POINTS), spark.createDataFrame(cutoffs, CUTS)
    got = {(r.token, r.cutoff): (r.reason, r.p, r.staleness_seconds) for r in asof.asof_decisions(p, c, limit, bucket).collect()}
    for token, cut in set(cutoffs):
        seen: dict = {}
        conflict = False
        for t, ts, v in points:
            if t == token and ts <= cut:
                conflict |= ts in seen and seen[ts] != v
                seen[ts] = v
        if conflict:
            want = (asof.CONFLICT, None, None)
        elif not seen:
            want = (asof.NO_POINT, None, None)
        else:
            last = max(seen)
            age = int((cut - last).total_seconds())
            want = (asof.STALE, None, None) if age > limit else (None, seen[last], age)
        assert got[token, cut] == want


def test_first_block_at_or_after(spark):
    blocks = spark.createDataFrame([(i, hours(10 * i)) for i in range(5)], "number long, ts timestamp")
    times = spark.createDataFrame([(hours(h),) for h in (-5, 0, 1, 40, 41)], "at timestamp")
    got = {r.at: r.number for r in asof.first_at_or_after(blocks, times).collect()}
    assert got == {hours(-5): 0, hours(0): 0, hours(1): 1, hours(40): 4, hours(41): None}


def test_curves_are_kept_whole(spark):
    rows = [("x", 900, "selected"), ("x", 900, "selected"), ("x", 1800, "selected"), ("x", 1800, "rejected"), ("y", 900, "selected")]
    df = spark.createDataFrame(rows, "event_id string, horizon_seconds long, status string")
    got = {(r.event_id, r.horizon_seconds): r.status for r in asof.complete_curves(df, 2).collect()}
    assert got == {("x", 900): "selected", ("x", 1800): "rejected", ("y", 900): "rejected"}
    kept = asof.retained_rows(df, asof.complete_curves(df, 2)).collect()
    assert [r.event_horizon_contract_count for r in kept] == [2, 2]
