"""Files that keep the canonical order: read by manifest against one sort of the whole table."""

from __future__ import annotations

import random

import pytest

from rungwise.operators.select import canonical_order
from rungwise.sources import ordered_files

SPLITS = {"fit": ("", ""), "tune": ("", ""), "judge": ("", "")}
SCHEMA = "split string, scheduled_time timestamp, event_id string, horizon_seconds int, threshold double, market_id string"


@pytest.fixture(scope="module")
def table(spark):
    from datetime import datetime, timedelta

    r = random.Random(9)
    rows = []
    for i in range(1500):
        split = r.choice(list(SPLITS))
        when = datetime(2031, 1, 1) + timedelta(hours=r.randrange(500))
        event = r.choice(["7", "10", "x1", "900", "b"])
        rows.append((split, when, event, r.choice([600, 3600]), r.choice([1.0, 2.5, 10.0]), f"m{i:04d}"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def path(spark, table, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("ordered") / "out")
    ordered_files.write(table, SPLITS, where, rows_per_file=120)
    return where


def test_manifest_order_is_the_sorted_order(spark, table, path):
    want = [r.market_id for r in canonical_order(table, SPLITS).collect()]
    assert [r.market_id for r in ordered_files.in_order(spark, path)] == want
    placed = {r.market_id: r.position for r in ordered_files.with_places(spark, path).collect()}
    assert placed == {m: i for i, m in enumerate(want)}
    plan = ordered_files.with_places(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortMergeJoin", "") and "rangepartitioning" not in plan


def test_manifest_bounds(spark, path):
    files = ordered_files.manifest(spark, path).orderBy("place").collect()
    assert len(files) > 12 and [f.place for f in files] == list(range(1, len(files) + 1))
    assert [f.before for f in files] == [sum(x.n for x in files[:i]) for i in range(len(files))]
    assert [s for i, s in enumerate(f.split for f in files) if i == 0 or files[i - 1].split != s] == list(SPLITS)
    for a, b in zip(files, files[1:]):
        assert a.split != b.split or a.last.scheduled_time <= b.first.scheduled_time


def test_a_stretch_reads_the_files_that_hold_it(spark, table, path):
    want = [r.market_id for r in canonical_order(table, SPLITS).collect()]
    got = ordered_files.stretch(spark, path, 700, 760)
    assert [r.market_id for r in sorted(got.collect(), key=lambda r: r.position)] == want[700:761]
    assert len(got.inputFiles()) <= 4
    assert ordered_files.stretch(spark, path, 5000, 6000).count() == 0
    start, end = "2031-01-05 00:00:00", "2031-01-06 12:00:00"
    some = ordered_files.between(spark, path, start, end, ["tune"])
    assert {r.market_id for r in some.collect()} == {
        r.market_id for r in table.where(f"split = 'tune' and scheduled_time >= '{start}' and scheduled_time < '{end}'").collect()
    }
    assert some.columns == [*[c for c in table.columns if c != "split"], "split", "position"]


def test_empty_table(spark, table, tmp_path):
    where = str(tmp_path / "none")
    ordered_files.write(table.where("false"), SPLITS, where)
    assert ordered_files.manifest(spark, where).count() == 0
    assert list(ordered_files.in_order(spark, where)) == []
    assert ordered_files.with_places(spark, where).count() == ordered_files.stretch(spark, where, 0, 9).count() == 0
