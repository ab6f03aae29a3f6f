from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.operators import isotonic
from rungwise.operators.isotonic import pool_nonincreasing, project_ladders


def brute(values, weights=None):
    """Min-max identity, cubic and obviously right."""
    y = np.asarray(values, float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    mean = lambda j, k: float(np.dot(w[j : k + 1], y[j : k + 1]) / w[j : k + 1].sum())
    n = len(y)
    return np.array(
        [min(max(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    )


def pool(values, weights=None):
    y = np.asarray(values, float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    return pool_nonincreasing(y, w, np.zeros(len(y), dtype=int))


# Published results that a projection must give.
def test_goldens():
    assert pool([0.8, 0.2, 0.6, 0.1]).tolist() == pytest.approx([0.8, 0.4, 0.4, 0.1])
    assert pool([0.9, 0.2, 0.8], [1, 3, 1]).tolist() == pytest.approx([0.9, 0.35, 0.35])
    assert pool([1.0, 0.8, 0.8, 0.2]).tolist() == [1.0, 0.8, 0.8, 0.2]
    assert pool([]).tolist() == []


def test_random_vectors_are_monotone_idempotent_and_keep_the_weighted_sum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        y, w = rng.random(n), rng.random(n) + 0.1
        x = pool(y, w)
        assert np.all(np.diff(x) <= 1e-12)
        assert np.allclose(pool(x, w), x)
        assert np.dot(w, x) == pytest.approx(np.dot(w, y))
        assert np.allclose(x, brute(y, w))


def test_groups_do_not_touch():
    y = np.array([0.1, 0.9, 0.2, 0.8])
    fitted = pool_nonincreasing(y, np.ones(4), np.array([0, 0, 1, 1]))
    assert fitted.tolist() == pytest.approx([0.5, 0.5, 0.5, 0.5])
    fitted = pool_nonincreasing(y, np.ones(4), np.array([0, 1, 1, 1]))
    assert fitted.tolist() == pytest.approx([0.1, 0.9, 0.5, 0.5])


def test_one_pair_per_round_falls_back_to_the_stack(monkeypatch):
    y = np.concatenate([np.linspace(1, 0, 300), [5000.0]])
    fast = pool(y)
    monkeypatch.setattr(isotonic, "_ROUNDS_BEFORE_STACK", 1)
    assert np.allclose(pool(y), fast)
    assert np.allclose(fast, y.mean())


def test_thresholds_give_the_order_and_payload_is_kept(spark):
    rows = [("e", 30.0, 0.5, "a"), ("e", 10.0, 0.7, "b"), ("e", 20.0, 0.8, "c")]
    df = spark.createDataFrame(rows, "event string, threshold double, p double, tag string")
    out = project_ladders(df, ["event"], "threshold", {"p": "fit"})
    assert {r.tag: r.fit for r in out.collect()} == pytest.approx({"a": 0.5, "b": 0.75, "c": 0.75})


@pytest.mark.parametrize("weighted", [False, True])
def test_hot_ladders_split_over_tasks_give_the_joint_solution(spark, weighted):
    rng = np.random.default_rng(11)
    ladders = {
        1: rng.random(90),
        2: np.linspace(0, 1, 60),
        3: np.concatenate([np.linspace(1, 0, 70), [40.0]]),
        4: rng.random(5),
        5: np.repeat([0.9, 0.4, 0.6], 25),
        6: np.linspace(1, 0, 40),
    }
    mass = {k: rng.random(len(v)) + 0.2 if weighted else np.ones(len(v)) for k, v in ladders.items()}
    rows = [
        (k, float(i), float(v), float(mass[k][i])) for k, y in ladders.items() for i, v in enumerate(y)
    ]
    df = spark.createDataFrame(rows, "event long, threshold double, p double, w double")
    out = project_ladders(
        df, ["event"], "threshold", {"p": "fit"}, weight="w" if weighted else None, max_rows=9
    )
    got = out.toPandas().sort_values(["event", "threshold"])
    assert len(got) == len(rows)
    for k, y in ladders.items():
        fitted = got[got.event == k].fit.to_numpy()
        assert np.allclose(fitted, brute(y, mass[k])), k
    assert got[got.event == 6].fit.tolist() == ladders[6].tolist()


def test_two_columns_in_one_pass(spark):
    df = spark.range(200).select(
        (F.col("id") % 40).alias("event"),
        F.floor(F.col("id") / 40).cast("double").alias("threshold"),
        F.rand(1).alias("a"),
        F.rand(2).alias("b"),
    ).cache()
    both = project_ladders(df, ["event"], "threshold", {"a": "fa", "b": "fb"}).toPandas()
    for _, group in both.sort_values("threshold").groupby("event"):
        assert np.allclose(group.fa, brute(group.a)) and np.allclose(group.fb, brute(group.b))


def test_derived_columns_are_made_where_the_ladder_lies(spark):
    """Columns that follow from a row alone do not move with it, and may be projected."""
    rows = [(e, float(t), ((3 * e + 5 * t) % 7) / 10) for e in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "e int, t double, p double")
    derive = lambda moved: moved.withColumn("twin", F.col("p") * F.col("p"))
    later = project_ladders(df, ["e"], "t", {"p": "a", "twin": "b"}, derive=derive)
    before = project_ladders(derive(df), ["e"], "t", {"p": "a", "twin": "b"})
    names = ["e", "t", "p", "twin", "a", "b"]
    assert sorted(later.select(*names).collect()) == sorted(before.select(*names).collect())
    plan = later._jdf.queryExecution().optimizedPlan().toString()
    assert "twin" not in plan[plan.index("RepartitionByExpression") :]
