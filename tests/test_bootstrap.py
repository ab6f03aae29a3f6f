from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.operators import bootstrap as bst


def events(spark, data):
    return spark.createDataFrame(data, "event_id string, block string, base double, model double")


def python_draw(seed, rep, slot, draw, bound, salts):
    p = bst.PRIME
    x = (seed * bst.SEED_STEP + rep * bst.REPLICATE_STEP + slot * bst.SLOT_STEP + (draw + 1) * bst.DRAW_STEP) % p
    for salt in (*salts, None):
        x = pow(x, 5, p)
        x = x if salt is None else (x + salt) % p
    return x % bound


def brute(diffs, resamples, seed):
    """``diffs``: block -> event -> difference; straight loops over the same generator."""
    blocks = sorted(diffs)
    means = []
    for rep in range(resamples):
        picked = []
        for slot in range(len(blocks)):
            block = blocks[python_draw(seed, rep, slot, 0, len(blocks), bst.BLOCK_SALTS)]
            values = [diffs[block][e] for e in sorted(diffs[block])]
            picked += [
                values[python_draw(seed, rep, slot, d, len(values), bst.EVENT_SALTS)]
                for d in range(len(values))
            ]
        means.append(np.mean(picked))
    return np.array(means)


@pytest.mark.parametrize("max_rows", [250_000, 5])
def test_replicates_match_plain_loops(spark, monkeypatch, max_rows):
    monkeypatch.setattr(bst, "REPLICATES_PER_TASK", 10)
    rng = np.random.default_rng(1)
    sizes = {"b1": 3, "b2": 23, "b3": 1, "b4": 8}
    diffs = {b: {f"{b}-{i:02d}": float(rng.normal()) for i in range(n)} for b, n in sizes.items()}
    rows = [(e, b, v) for b, d in diffs.items() for e, v in d.items()]
    df = spark.createDataFrame(rows, "event_id string, block string, d double")
    got = bst.replicates(df, ["d"], 25, [9], max_rows=max_rows).orderBy("replicate").toPandas()
    assert np.allclose(got.d.to_numpy(), brute(diffs, 25, 9))


def test_draws_are_split_without_loss():
    """All chunks of a block together get its draws, each about its share."""
    n, size, blocks = 1003, 64, 5
    chunks = [bst.chunk_draws(c, n, size, 2, blocks, 11, 20, 820) for c in range(-(-n // size))]
    pairs = bst.picks(2, blocks, 11, 20, 820)
    assert (sum(chunks) == np.bincount(pairs[:, 0] - 20, minlength=800) * n).all()
    shares = np.array([c.sum() for c in chunks]) / (len(pairs) * n)
    assert np.allclose(shares[:-1], size / n, rtol=0.02) and shares[-1] == pytest.approx((n % size) / n, rel=0.05)


def test_split_counts_have_the_moments_of_single_draws():
    """Mean, variance and covariance of how often events are drawn, against the binomial's."""
    n, size, reps = 40, 8, 40_000
    counts = []
    for chunk in range(5):
        which, table = bst.chunk_sums(np.eye(size), chunk, n, size, 0, 1, 3, 0, reps)
        full = np.zeros((reps, size))
        full[which] = table[:, 1:]
        counts.append(full)
    counts = np.hstack(counts)
    assert (counts.sum(1) == n).all()
    cov = np.cov(counts.T)
    assert np.allclose(counts.mean(0), 1, atol=0.03)
    assert np.allclose(np.diag(cov), 1 - 1 / n, atol=0.05)
    off = cov[~np.eye(n, dtype=bool)]
    assert abs(off.mean() + 1 / n) < 0.002 and abs(off).max() < 0.05


@pytest.mark.parametrize(("block_events", "chunk_events"), [(5, 4), (0, 7)])
def test_split_blocks_agree_in_distribution(spark, block_events, chunk_events):
    """Some blocks or all of them above the limit: same mean and spread as single draws."""
    rng = np.random.default_rng(1)
    sizes = {"b1": 3, "b2": 123, "b3": 1, "b4": 58}
    rows = [(f"{b}-{i:03d}", b, float(rng.normal() + k)) for k, (b, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id string, block string, d double")
    options = {"max_rows": 20, "block_events": block_events, "chunk_events": chunk_events}
    got = bst.replicates(df, ["d"], 4000, [9], **options).orderBy("replicate").toPandas()
    again = bst.replicates(df.repartition(3), ["d"], 4000, [9], **options).orderBy("replicate").toPandas()
    assert len(got) == 4000 and np.allclose(got.d, again.d)
    drawn = bst.replicates(df, ["d"], 4000, [9]).orderBy("replicate").toPandas().d
    # Which blocks a replicate picks is the same, so the replicates themselves are close.
    assert np.corrcoef(got.d, drawn)[0, 1] > 0.95
    assert got.d.mean() == pytest.approx(drawn.mean(), abs=0.02) and got.d.std() == pytest.approx(drawn.std(), rel=0.05)
    assert np.quantile(got.d, [0.025, 0.975]) == pytest.approx(np.quantile(drawn, [0.025, 0.975]), abs=0.08)


def test_a_large_block_makes_no_row_per_draw(spark):
    """2,000 replicates of 60,000 draws each: rows in the plan stay with chunks and replicates."""
    df = spark.range(120_000).select(
        F.col("id").cast("string").alias("event_id"), F.when(F.col("id") < 60_000, "x").otherwise("y").alias("block"),
        (F.col("id") % 100).cast("double").alias("d"),
    )
    got = bst.replicates(df, ["d"], 2000, [1]).toPandas().d
    assert len(got) == 2000 and got.mean() == pytest.approx(49.5, abs=0.02)
    # Two equal blocks of the same values: only the draws inside them vary.
    assert got.std() == pytest.approx(np.std(np.arange(100)) / np.sqrt(120_000), rel=0.1)


def test_strata_and_seeds_are_independent(spark):
    rows = [(f"e{i}", f"b{i % 3}", float(i), s) for i in range(12) for s in ("x", "y")]
    df = spark.createDataFrame(rows, "event_id string, block string, d double, s string")
    both = bst.replicates(df, ["d"], 10, [1, 2], ["s"]).toPandas()
    assert len(both) == 40
    alone = bst.replicates(df.where("s = 'x'").drop("s"), ["d"], 10, [2]).toPandas()
    pick = both[(both.s == "x") & (both.seed == 2)].sort_values("replicate")
    assert np.allclose(pick.d.to_numpy(), alone.sort_values("replicate").d.to_numpy())


def test_constant_improvement(spark):
    data = [(f"e{i}", f"b{i % 4}", 0.30, 0.20) for i in range(12)]
    row = bst.paired_bootstrap(events(spark, data), "base", "model", 50, 0.9, 3).first()
    assert (row.estimate, row.lower, row.upper) == pytest.approx((0.1, 0.1, 0.1))


def test_rows_are_averaged_within_events(spark):
    data = [("a", "1", 0.4, 0.2), ("a", "1", 0.2, 0.2), ("b", "1", 0.5, 0.4), ("c", "2", 0.4, 0.5)]
    row = bst.paired_bootstrap(events(spark, data), "base", "model", 20, 0.95, 1).first()
    assert row.estimate == pytest.approx(1 / 30)


def test_interval_covers_the_spread_of_the_mean(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=400)
    df = spark.createDataFrame(
        [(f"e{i}", f"b{i % 40}", float(v)) for i, v in enumerate(values)],
        "event_id string, block string, d double",
    )
    drawn = bst.replicates(df, ["d"], 300, [5]).toPandas().d
    blocks = np.array([values[i::40] for i in range(40)])
    draws = np.random.default_rng(8)
    loops = []
    for _ in range(300):
        chosen = blocks[draws.integers(0, 40, 40)]
        loops.append(np.mean([b[draws.integers(0, 10, 10)] for b in chosen]))
    assert drawn.std() == pytest.approx(np.std(loops), rel=0.2)
    assert drawn.mean() == pytest.approx(values.mean(), abs=4 * np.std(loops) / np.sqrt(300))


@pytest.mark.parametrize(
    ("data", "message"),
    [
        ([], "no events"),
        ([("a", "1", 0.1, 0.1), ("a", "2", 0.1, 0.1)], "several blocks"),
        ([("a", "1", 0.1, 0.1), ("b", "1", 0.1, 0.1)], "two of them"),
        ([("a", "1", -0.1, 0.1), ("b", "2", 0.1, 0.1)], "negative"),
        ([("a", "1", float("nan"), 0.1), ("b", "2", 0.1, 0.1)], "finite"),
    ],
)
def test_bad_inputs(spark, data, message):
    with pytest.raises(ValueError, match=message):
        bst.paired_bootstrap(events(spark, data), "base", "model", 5)


def test_kernel_in_small_pieces(monkeypatch):
    values = np.random.default_rng(0).normal(size=(37, 2))
    whole = bst.block_sums(values, 1, 5, 3, 10, 60)
    monkeypatch.setattr(bst, "KERNEL_CELLS", 64)
    parts = bst.block_sums(values, 1, 5, 3, 10, 60)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


@pytest.mark.parametrize("kwargs", [{"resamples": 0}, {"resamples": True}, {"confidence": 1.0}, {"seed": -1}])
def test_bad_settings(kwargs):
    with pytest.raises(ValueError):
        bst.check_settings(**({"resamples": 10, "confidence": 0.9, "seed": 0} | kwargs))


def test_percentiles_interpolate(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("d"))
    row = bst.intervals(df, ["d"], 0.95).first()
    assert (row.lower, row.upper) == pytest.approx(tuple(np.quantile(range(11), [0.025, 0.975])))


def test_neighbouring_chunks_worked_together_are_those_worked_alone():
    values = np.random.default_rng(2).normal(size=(40, 2))
    which, table = bst.chunk_sums(values[8:32], 1, 40, 8, 1, 3, 5, 10, 60)
    whole = np.zeros((50, 3))
    whole[which - 10] = table
    parts = np.zeros((50, 3))
    for chunk in (1, 2, 3):
        at, sums = bst.chunk_sums(values[chunk * 8 : chunk * 8 + 8], chunk, 40, 8, 1, 3, 5, 10, 60)
        parts[at - 10] += sums
    assert np.allclose(whole, parts) and whole[:, 0].any()


def test_small_chunks_do_not_each_return_a_row_per_replicate(spark):
    """64 chunks of 16 events in a block: the kernel gets one array for all of them."""
    df = spark.range(2048).select(
        F.col("id").cast("string").alias("event_id"), (F.col("id") % 2).cast("string").alias("block"), F.rand(1).alias("d")
    )
    seen = []
    real = bst._kernel
    bst._kernel = lambda *args: seen.append(args) or real(*args)
    try:
        got = bst.replicates(df, ["d"], 50, [1], block_events=0, chunk_events=16).toPandas()
    finally:
        bst._kernel = real
    assert len(got) == 50 and seen[0][-2:] == (16, bst.CHUNK_EVENTS // 16)


def test_many_pools_move_once_and_few_once_per_range(spark, monkeypatch):
    monkeypatch.setattr(bst, "REPLICATES_PER_TASK", 10)
    rng = np.random.default_rng(4)
    rows = [(f"e{i:03d}", f"b{i % 5}", float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id string, block string, d double")
    found, generated = [], []
    for pools in (0, 1_000_000):
        monkeypatch.setattr(bst, "POOLS_PER_CORE", pools)
        got = bst.replicates(df, ["d"], 40, [6])
        found.append(got.orderBy("replicate").toPandas().d.to_numpy())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        generated.append(plan.index("Generate") < plan.index("Repartition"))
    assert np.allclose(*found) and generated == [True, False]


def test_the_gate_makes_the_intervals_it_reads_and_no_others(spark):
    from rungwise.plans import evaluate as ev
    from rungwise.workload import views

    rng = np.random.default_rng(8)
    losses = [f"{m}__{loss}" for m in ev.METHODS for loss in ("brier", "log")]
    rows = [("holdout", h, f"e{i}", f"b{i % 4}", *map(float, rng.random(10))) for i in range(30) for h in (1800, 900)]
    kinds = "split string, horizon_seconds bigint, event_id string, block string, " + ", ".join(f"{c} double" for c in losses)
    held = spark.createDataFrame(rows, kinds)
    whole = ev.comparison_intervals(held, views.PROTOCOL, 1_000).where("loss = 'brier' and horizon_seconds = 1800")
    part = ev.comparison_intervals(held, views.PROTOCOL, 1_000, ("brier",), [1800])
    text = lambda df: sorted((r.comparison, round(r.lower, 12), round(r.upper, 12)) for r in df.collect())
    assert len(text(part)) == 4 and text(part) == text(whole)
