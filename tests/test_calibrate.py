from __future__ import annotations

import numpy as np
import pytest

from rungwise.operators import calibrate as cal

SCHEMA = "event_id string, horizon_seconds long, p double, label double"


def frame(spark, data):
    return spark.createDataFrame([(e, 900, float(p), float(y)) for e, p, y in data], SCHEMA)


def noisy(n=60, seed=2):
    rng = np.random.default_rng(seed)
    p = rng.random(n)
    y = (rng.random(n) < p**1.5).astype(float)
    return [(f"e{i // 3}", p[i], y[i]) for i in range(n)]


def dense_newton(data, method, settings=cal.Settings()):
    """Undamped Newton on the uncompressed rows."""
    counts = {}
    for e, _, _ in data:
        counts[e] = counts.get(e, 0) + 1
    w = np.array([1 / (len(counts) * counts[e]) for e, _, _ in data])
    p = np.clip([r[1] for r in data], settings.epsilon, 1 - settings.epsilon)
    y = np.array([r[2] for r in data])
    x = np.log(p) - np.log1p(-p) if method == "platt" else None
    design = np.column_stack([np.ones(len(y)), x] if method == "platt" else [np.ones(len(y)), np.log(p), -np.log1p(-p)])
    theta = np.array([0.0] + [1.0] * (design.shape[1] - 1))
    mask = np.array([0.0] + [1.0] * (design.shape[1] - 1))
    for _ in range(30):
        s = 1 / (1 + np.exp(-design @ theta))
        g = design.T @ (w * (s - y)) + settings.l2 * mask * theta
        h = (design * (w * s * (1 - s))[:, None]).T @ design + np.diag(settings.l2 * mask)
        theta = theta - np.linalg.solve(h, g)
    return theta


@pytest.mark.parametrize("method", ["platt", "beta"])
def test_matches_a_dense_solver(spark, method):
    data = noisy()
    (model,) = cal.fit_calibrators(frame(spark, data), [900], (method,))
    theta = dense_newton(data, method)
    assert [model.intercept, *model.coefficients] == pytest.approx(theta.tolist(), abs=1e-8)


def test_event_balanced_weights(spark):
    df = frame(spark, [("L", 0.1, 0), ("L", 0.2, 0), ("L", 0.3, 1), ("S", 0.4, 1)])
    got = cal.event_balanced_weights(df, ["horizon_seconds"]).toPandas().sort_values("p")
    assert got.weight.tolist() == pytest.approx([1 / 6, 1 / 6, 1 / 6, 1 / 2])


def test_uninformative_prices_give_a_flat_model(spark):
    data = [("a", 0.5, 0), ("a", 0.5, 1), ("b", 0.5, 0), ("b", 0.5, 1)]
    (model,) = cal.fit_calibrators(frame(spark, data), [900], ("platt",), cal.Settings(l2=0.5))
    assert model.intercept == pytest.approx(0.0, abs=1e-9)
    assert model.coefficients[0] == pytest.approx(0.0, abs=1e-8)


def test_repeating_an_events_rows_changes_nothing(spark):
    data = noisy(30)
    first = [r for r in data if r[0] == "e0"]
    (once,) = cal.fit_calibrators(frame(spark, data), [900], ("platt",))
    (more,) = cal.fit_calibrators(frame(spark, data + first * 2), [900], ("platt",))
    assert once.intercept == pytest.approx(more.intercept, abs=1e-10)
    assert once.coefficients == pytest.approx(more.coefficients, abs=1e-10)


def test_failures_raise(spark):
    data = noisy(30)
    with pytest.raises(cal.ConvergenceError, match="tolerance"):
        cal.fit_calibrators(frame(spark, data), [900], ("platt",), cal.Settings(max_iterations=0))
    with pytest.raises(ValueError, match="both kinds"):
        cal.fit_calibrators(frame(spark, [("a", 0.5, 1), ("b", 0.4, 1)]), [900])
    with pytest.raises(ValueError, match="outside"):
        cal.fit_calibrators(frame(spark, [("a", 1.5, 1), ("b", 0.4, 0)]), [900])
    with pytest.raises(ValueError, match="neither"):
        cal.fit_calibrators(frame(spark, [("a", 0.5, 0.5), ("b", 0.4, 0)]), [900])
    with pytest.raises(ValueError, match="no rows to fit on"):
        cal.fit_calibrators(frame(spark, data), [900, 1800])
    with pytest.raises(ValueError, match="epsilon"):
        cal.Settings(epsilon=0.5)


def test_prediction_is_clipped(spark):
    model = cal.Model(900, "platt", 0.0, (5.0,), 1, 0.0)
    df = frame(spark, [("a", 0.0, 0), ("a", 0.5, 0), ("a", 1.0, 1)])
    got = cal.apply_calibrators(df, [model], 1e-3).toPandas().sort_values("p").p_platt.tolist()
    assert got == pytest.approx([1e-3, 0.5, 1 - 1e-3])
