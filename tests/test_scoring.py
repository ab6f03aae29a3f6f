from __future__ import annotations

import math

import pytest

from rungwise.operators import scoring


def rows(spark, data):
    return spark.createDataFrame(data, "s string, event_id string, threshold double, p double, label double")


def macro(spark, data, epsilon=1e-6):
    events = scoring.event_losses(rows(spark, data), ["s", "event_id"], {"raw": "p"}, epsilon)
    return scoring.macro_scores(events, ["s"], ["raw"]).first()


def test_events_weigh_the_same(spark):
    data = [("x", "L", 1.0, 1.0, 1.0), ("x", "L", 2.0, 1.0, 1.0), ("x", "L", 3.0, 1.0, 1.0), ("x", "S", 1.0, 1.0, 0.0)]
    found = macro(spark, data)
    assert found["raw__brier"] == pytest.approx(0.5)
    assert (found["rows"], found["events"]) == (4, 2)


def test_log_loss_is_clipped(spark):
    data = [("x", "a", 1.0, 0.0, 1.0), ("x", "b", 1.0, 1.0, 0.0)]
    assert macro(spark, data, 1e-3)["raw__log"] == pytest.approx(-math.log(1e-3))
    with pytest.raises(ValueError, match="epsilon"):
        macro(spark, data, 0.5)


def test_violations_use_a_strict_tolerance(spark):
    data = [("x", "a", 1.0, 0.5, 1.0), ("x", "a", 2.0, 0.5 + 5e-13, 1.0), ("x", "a", 3.0, 0.7, 0.0), ("x", "b", 1.0, 0.3, 0.0)]
    found = scoring.violations(rows(spark, data), ["event_id"], ["s"], "threshold", {"raw": "p"}).first()
    assert (found["raw__edges"], found["raw__violating_events"]) == (1, 1)


def test_a_perfect_baseline_has_no_relative_improvement(spark):
    wide = spark.createDataFrame(
        [("x",) + (0.0,) * 10],
        "s string, " + ", ".join(f"{m}__{l} double" for m in ("raw", "pav_raw", "platt", "beta", "pav_beta") for l in ("brier", "log")),
    )
    with pytest.raises(Exception, match="nothing to improve"):
        scoring.comparisons(wide, ["s"]).collect()
