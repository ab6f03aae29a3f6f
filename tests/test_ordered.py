from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rungwise.operators.ordered import percentiles, segment, with_index, with_next
from rungwise.operators.scoring import violations
from rungwise.operators.quality import rising_label_edges


def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in ((1, 200), (2, 3), (3, 120), (4, 1)):
        for t in rng.permutation(n):
            rows.append((key, float(t), float(rng.random())))
    return spark.createDataFrame(rows, "key long, t double, p double")


def test_next_and_index_cross_segment_borders(spark):
    df = frame(spark)
    parts = segment(df, ["key"], "t", max_rows=10)
    assert parts.hot
    assert parts.df.groupBy("key", "_segment").count().agg({"count": "max"}).first()[0] < 60
    pdf = df.toPandas().sort_values(["key", "t"])
    pdf["next"] = pdf.groupby("key").p.shift(-1)
    got = with_next(parts, "p", "next").toPandas().sort_values(["key", "t"])
    np.testing.assert_array_equal(got.next.to_numpy(), pdf.next.to_numpy())
    pdf["i"] = pdf.groupby("key").cumcount()
    placed = with_index(parts, "i").toPandas().sort_values(["key", "t"])
    assert placed.i.tolist() == pdf.i.tolist()


def test_small_groups_need_no_split(spark):
    parts = segment(frame(spark), ["key"], "t", max_rows=500)
    assert not parts.hot and "_segment" in parts.df.columns


def test_violations_do_not_depend_on_the_split(spark):
    df = frame(spark).withColumnRenamed("key", "event_id")
    keys = ["event_id"]
    whole = violations(df, keys, [], "t", {"raw": "p"}).first()
    split = violations(df, keys, [], "t", {"raw": "p"}, max_rows=7).first()
    assert whole == split and whole["raw__edges"] > 100


def test_label_edges(spark):
    rows = [(1, 900, float(t), float(t % 2)) for t in range(40)]
    df = spark.createDataFrame(
        rows, "event_id long, horizon_seconds long, threshold double, label double"
    )
    assert rising_label_edges(df).count() == rising_label_edges(df, max_rows=6).count() == 20


def test_percentiles_match_numpy_for_any_split(spark):
    rng = np.random.default_rng(9)
    rows = [(1, float(v)) for v in rng.integers(0, 60, 400)] + [(2, 7.0)] * 30 + [(3, 0.5)]
    df = spark.createDataFrame(rows, "key long, v double")
    marks = {"a": 0.025, "b": 0.5, "c": 0.975}
    for limit in (1_000, 7):
        for row in percentiles(df, ["key"], "v", marks, max_rows=limit).collect():
            values = [v for k, v in rows if k == row.key]
            np.testing.assert_allclose([row.a, row.b, row.c], np.quantile(values, list(marks.values())))
    whole = percentiles(df, [], "v", marks).first()
    np.testing.assert_allclose([whole.a, whole.b, whole.c], np.quantile([v for _, v in rows], list(marks.values())))


def with_nulls():
    rows = [(k, float(t), None if t % 3 == 0 else float(t * k)) for k in (1, 2) for t in range(40)]
    return rows + [(None, float(t), None if t % 4 == 0 else float(t)) for t in range(30)] + [(3, 0.0, None)]


def test_nulls_give_the_same_on_both_size_paths(spark):
    df = spark.createDataFrame(with_nulls(), "key long, t double, p double")
    def got(limit, add):
        return sorted(map(tuple, add(segment(df, ["key"], "t", limit)).collect()), key=str)
    for add in (lambda parts: with_next(parts, "p", "x"), lambda parts: with_index(parts, "x")):
        assert got(1000, add) == got(7, add)
    following = {(k, t): x for k, t, _, x in got(7, lambda parts: with_next(parts, "p", "x"))}
    for k, t, _ in with_nulls():
        want = next((p for a, b, p in with_nulls() if a == k and b == t + 1), None)
        assert following[k, t] == want


def test_percentiles_ignore_nulls_and_keep_null_keys(spark):
    df = spark.createDataFrame(with_nulls() + [(1, 0.0, 5.0)] * 9, "key long, t double, v double")
    want = {r.key: (r.a, r.b) for r in df.groupBy("key").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    assert want[3] == (None, None) and None in want
    for limit in (1000, 5):
        rows = percentiles(df, ["key"], "v", {"a": 0.25, "b": 0.9}, limit).collect()
        assert {r.key for r in rows} == set(want)
        for r in rows:
            assert (r.a, r.b) == want[r.key] or np.allclose([r.a, r.b], want[r.key])
    simple = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    whole = percentiles(simple, [], "v", {"m": 0.5})
    assert whole.first().m == 2.0
    assert "CartesianProduct" not in whole._jdf.queryExecution().executedPlan().toString()
