"""Windows landed one after the other against one run over all of them."""

from __future__ import annotations

import random

import pytest

from rungwise.operators import seen_state, select
from rungwise.operators.quality import DataQualityError

SCHEMA = "id string, window int, page int, selection string, full string, payload string"
ORDER = ["window", "page"]


def windows(n=3):
    """Overlapping windows: an id has one selection, but unused fields change now and then."""
    r = random.Random(4)
    out = []
    for w in range(n):
        rows = []
        for page in range(150):
            i = r.randrange(60 * w, 60 * w + 120)
            version = r.randrange(3)
            rows.append((f"e{i}", w, page, f"s{i}", f"f{i}.{version}", f"{w}:{page}"))
        out.append(rows + [(None, w, 900, "s", "f", "null id"), *rows[:4]])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state_in(spark, tmp_path, name):
    return seen_state.open_state(frame(spark, []), ORDER, str(tmp_path / name), 4)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_windows_one_by_one_equal_one_run(spark, tmp_path, order):
    parts = windows()
    state = state_in(spark, tmp_path, f"w{order[0]}")
    landed = []
    for w in order:
        report = seen_state.land(state, frame(spark, parts[w]), ORDER, f"w{w}")
        landed += parts[w]
        so_far = {tuple(r) for r in select.first_seen(frame(spark, landed), ORDER).collect()}
        ids = {row[0] for row in parts[w]}
        assert {tuple(r) for r in report.collect()} == {r for r in so_far if r[0] in ids}
        assert {tuple(r) for r in seen_state.first_seen(spark, state).collect()} == so_far


def test_a_changed_selection_is_fatal_and_nothing_is_kept(spark, tmp_path):
    state = state_in(spark, tmp_path, "conflict")
    seen_state.land(state, frame(spark, windows()[0]), ORDER, "one")
    before = spark.table(state.table).count()
    shown = windows()[0][0]
    bad = [("new", 1, 0, "s", "f", "p"), (shown[0], 1, 1, "other", "g", "q")]
    with pytest.raises(DataQualityError, match=shown[0]):
        seen_state.land(state, frame(spark, bad), ORDER, "two")
    assert spark.table(state.table).count() == before
    seen_state.land(state, frame(spark, bad[:1]), ORDER, "two")  # the window can land once mended


def test_a_window_lands_once_and_empty_ones_change_nothing(spark, tmp_path):
    state = state_in(spark, tmp_path, "once")
    rows = frame(spark, windows()[0])
    assert seen_state.land(state, rows.where("false"), ORDER, "none").count() == 0
    seen_state.land(state, rows, ORDER, "first")
    with pytest.raises(ValueError, match="landed before"):
        seen_state.land(state, rows, ORDER, "first")
    # A later session finds the state by its path.
    spark.sql(f"drop table {state.table}")
    again = state_in(spark, tmp_path, "once")
    want = {tuple(r) for r in select.first_seen(rows, ORDER).collect()}
    assert {tuple(r) for r in seen_state.first_seen(spark, again).collect()} == want


def test_stored_rows_are_not_moved(spark, tmp_path):
    state = state_in(spark, tmp_path, "still")
    seen_state.land(state, frame(spark, windows()[0]), ORDER, "one")
    plan = seen_state.first_seen(spark, state)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_a_window_meets_the_state_where_both_lie(spark, tmp_path):
    """Its contents are moved once; the check of changed ids moves neither side."""
    state = state_in(spark, tmp_path, "met")
    seen_state.land(state, frame(spark, windows()[0]), ORDER, "one")
    other = [(None, 1, 0, "other", "g", "q"), ("e1000", 1, 0, "s", "f", "p"), ("e1000", 1, 1, "t", "f", "p")]
    contents = seen_state._bucketed(select.contents_of(frame(spark, windows()[1] + other), ORDER), state.files)
    changed = seen_state._changed(spark, state, contents)
    assert "Exchange hashpartitioning" not in changed._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in changed.collect()} == {None, "e1000"}
