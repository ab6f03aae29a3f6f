"""Catalogues and summaries counted without rows by all keys in one task."""

from __future__ import annotations

import datetime
import glob

from rungwise import session
from rungwise.operators import compare
from rungwise.sources import quarantine
from rungwise.workload import quality_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalogues_meet_as_sets_in_one_aggregate(spark):
    kind = "table_name string, column_name string"
    found = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), (None, "c")], kind)
    declared = spark.createDataFrame([("t", "b"), ("t", "d"), ("t", "d"), (None, "c")], kind)
    odd = compare.column_differences(found, declared)
    assert _plan(odd).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, odd.collect())) == [("t", "a", "unexpected"), ("t", "d", "missing")]


def test_summary_counts_each_key_by_itself(spark):
    kind = "event_id string, market_id string, horizon_seconds bigint"
    rows = [("e", "m", 900), ("e", "m", 900), ("e", "n", 1800), ("f", "m", None), (None, "o", 900), ("f", None, 900)]
    summary = compare.dataset_summary(spark.createDataFrame(rows, kind))
    assert "Expand" not in _plan(summary)
    assert tuple(summary.first()) == (6, 2, 3, 3)
    assert tuple(compare.dataset_summary(spark.createDataFrame([], kind)).first()) == (None, 0, 0, 0)


def test_candidate_files_are_written_by_as_many_tasks_as_the_session_deals(spark, small_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        quality_queries.candidate_files(spark, small_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (path,) = [p for p in session._SCRATCH[-6:] if "csv-lines" in p]
    assert len(glob.glob(f"{path.removeprefix('file:')}/part=*")) == 7


def test_candidate_lines_are_judged_once(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"eventId": "e"}\n{"eve\n')
    good, bad = quarantine.read_candidates(spark, str(tmp_path))
    for part in (good, bad):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "regexp" not in plan.lower()
    assert good.count() == 0 and {"corrupt_line", "missing_condition_id"} <= {r.rule_id for r in bad.collect()}


def test_rows_meet_as_keys_and_digests(spark):
    kind = "k string, n bigint, p double, at timestamp, t string"
    def at(micros):
        return datetime.datetime(2024, 1, 1, microsecond=micros)

    left = [("a", 1, 0.0, at(1), "x"), ("a", 1, 0.0, at(1), "x"), ("b", 1, None, at(2), None), (None, 2, 0.5, None, "y"), ("c", 1, 0.1, at(3), "z")]
    right = [("a", 1, -0.0, at(1), "x"), ("b", 1, None, at(2), "null"), (None, 2, 0.5, None, "y"), ("c", 1, 0.1, at(4), "z")]
    one, two = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    narrow = compare.key_differences(one, two, ("k", "n"))
    whole = compare.table_differences(one, two).select("k", "n", "surplus")
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, narrow.collect())) == [("a", 1, 1), ("b", 1, -1), ("b", 1, 1), ("c", 1, -1), ("c", 1, 1)]
    moved = _plan(narrow)
    assert "Exchange hashpartitioning(k" in moved and "hashpartitioning(k#" in moved
    assert " t#" not in moved[moved.index("Exchange hashpartitioning") :].split("\n")[0]
