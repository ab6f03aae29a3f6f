"""Stored histories: the same answers as the direct as-of join, and stored sides that stay put."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from rungwise.operators import asof
from rungwise.sources import price_store

BASE = datetime(2031, 3, 4)
POINTS = "token string, ts timestamp, p double"
CUTS = "token string, cutoff timestamp"


def history(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for token in "uvwx":
        for s in rng.integers(0, 400_000, 80):
            rows.append((token, BASE + timedelta(seconds=int(s)), round(float(rng.random()), 3)))
    rows += rows[:9]  # copies
    rows += [("x", BASE + timedelta(seconds=200_000), 0.1), ("x", BASE + timedelta(seconds=200_000), 0.9)]  # a conflict
    return rows + [(None, BASE, 0.5), ("u", None, 0.5), ("u", BASE + timedelta(days=9), None)]


def cutoffs(seed=6):
    rng = np.random.default_rng(seed)
    rows = [(t, BASE + timedelta(seconds=int(s))) for t in "uvwxy" for s in rng.integers(-90_000, 900_000, 60)]
    return rows + [(t, ts) for t, ts, _ in history()[:20]] + [(None, BASE), ("u", None)] + rows[:3]


@pytest.mark.parametrize("bucket", [600, 86_400, 86_400 * 30])
def test_as_the_direct_join(spark, tmp_path, bucket):
    points = spark.createDataFrame(history(), POINTS)
    asked = spark.createDataFrame(cutoffs(), CUTS)
    store = price_store.write(points, str(tmp_path / f"store-{bucket}"), 5, bucket)
    got = price_store.decisions(spark, store, asked, 7200)
    want = asof.asof_decisions(points.where("p is not null"), asked, 7200)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    reasons = {r.reason for r in want.collect()}
    assert reasons == {None, asof.NO_POINT, asof.STALE, asof.CONFLICT}


def test_neither_stored_table_is_shuffled(spark, tmp_path):
    points = spark.createDataFrame(history(), POINTS)
    store = price_store.write(points, str(tmp_path / "still"), 5)
    got = price_store.latest_at_or_before(spark, store, spark.createDataFrame(cutoffs(), CUTS))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "FileScan parquet" in line]
    assert len(scans) == 2 and all("Bucketed: true" in plan[i] for i in scans)
    for i in scans:
        depth = plan[i].index("FileScan")
        for line in reversed(plan[:i]):  # upwards, from the scan to the join it feeds
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                depth = at
                assert "Exchange" not in line
                if "SortMergeJoin" in line:
                    break
        else:
            raise AssertionError("the scan feeds no merge join")
    # As many files per table as buckets: a new cutoff table meets them as they are.
    for table in (store.days, store.tokens):
        assert 1 <= len(spark.table(table).inputFiles()) <= 5


def test_a_store_is_found_again(spark, tmp_path):
    points = spark.createDataFrame(history(), POINTS)
    store = price_store.write(points, str(tmp_path / "kept"), 3)
    asked = spark.createDataFrame(cutoffs(), CUTS)
    before = sorted(map(str, price_store.decisions(spark, store, asked, 60).collect()))
    for table in (store.days, store.tokens):
        spark.sql(f"drop table {table}")
    again = price_store.attach(spark, str(tmp_path / "kept"))
    assert again == store
    assert sorted(map(str, price_store.decisions(spark, again, asked, 60).collect())) == before


def test_empty_store_and_empty_questions(spark, tmp_path):
    store = price_store.write(spark.createDataFrame([], POINTS), str(tmp_path / "none"), 2)
    got = price_store.decisions(spark, store, spark.createDataFrame([("u", BASE)], CUTS), 60).collect()
    assert [(r.token, r.reason) for r in got] == [("u", asof.NO_POINT)]
    assert price_store.decisions(spark, store, spark.createDataFrame([], CUTS), 60).count() == 0


def test_binary_search(spark):
    rows = [([], 5), ([5], 4), ([5], 5), ([1, 3, 3, 9], 3), ([1, 3, 3, 9], 0), (list(range(1000)), 998), (list(range(1000)), 5000)]
    df = spark.createDataFrame(rows, "a array<bigint>, v bigint")
    import pyspark.sql.functions as F

    got = [r[0] for r in df.select(price_store.count_upto("a", F.col("v"))).collect()]
    assert got == [sum(x <= v for x in a) for a, v in rows]
