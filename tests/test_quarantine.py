"""Candidate files with bad lines: each is found under its file and line, the rest is read."""

from __future__ import annotations

import gzip
import json

import pytest

from rungwise.sources import quarantine

HEADER = ["eventId", "conditionId", "endDate", "split", "horizon", "gamma_candidate_label"]


def row(i, **changes):
    good = {
        "eventId": f"e{i}", "conditionId": f"0x{i:064x}", "endDate": "2031-02-03T04:05:06Z", "split": "fit", "horizon": "600",
        "gamma_candidate_label": "Yes" if i % 2 else "No",
    }
    return good | changes


def read(spark, path, header=None):
    good, bad = quarantine.read_candidates(spark, str(path), header)
    name = lambda text: text.rsplit("/", 1)[-1]
    return (
        {(name(r.file), r.line): r.event_id for r in good.collect()},
        {(name(r.key), r.rule_id) for r in bad.collect()},
    )


def test_json_lines(spark, tmp_path):
    lines = [json.dumps(row(1)), "", "{torn", json.dumps(row(2) | {"event_id": "other"}), "[1, 2]", "7", json.dumps(row(3, endDate="soon", note=1))]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "b.json.gz", "wt") as out:
        out.write(json.dumps(row(4, horizon=600)) + "\n" + json.dumps(row(5, split=" ")))
    good, bad = read(spark, tmp_path)
    assert good == {("a.json", 1): "e1", ("b.json.gz", 1): "e4"}
    assert bad == {
        ("a.json:3", "corrupt_line"), ("a.json:4", "conflicting_event_id"), ("a.json:5", "corrupt_line"), ("a.json:6", "corrupt_line"),
        ("a.json:7", "bad_target"), ("b.json.gz:2", "missing_split"),
    }


def test_csv(spark, tmp_path):
    def line(values):
        return ",".join('"' + str(v).replace('"', '""') + '"' for v in values)

    rows = [row(1), row(2, conditionId="0x1"), row(3, eventId='with "quotes", and comma')]
    text = [",".join(HEADER), *[line(r.values()) for r in rows], "too,few", line([*row(4).values(), "more"]), "", line(row(5).values())]
    (tmp_path / "a.csv").write_text("\n".join(text))
    (tmp_path / "b.csv").write_text("\n".join(["something,else", line(row(6).values())]))
    good, bad = read(spark, tmp_path, HEADER)
    assert good == {("a.csv", 2): "e1", ("a.csv", 4): 'with "quotes", and comma', ("a.csv", 8): "e5", ("b.csv", 2): "e6"}
    assert bad == {("a.csv:3", "bad_condition_id"), ("a.csv:5", "corrupt_line"), ("a.csv:6", "corrupt_line"), ("b.csv:1", "header_differs")}


def test_line_numbers_across_blocks_of_a_file(spark, tmp_path):
    (tmp_path / "long.json").write_text("".join(json.dumps(row(i)) + "\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = quarantine.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = {r.line: json.loads(r.value)["eventId"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"e{i}" for i in range(1, 4001)}


@pytest.mark.parametrize("header", [None, HEADER])
def test_empty_file(spark, tmp_path, header):
    (tmp_path / "none").write_text("")
    assert read(spark, tmp_path, header) == ({}, set())


def test_whole_documents(spark, tmp_path):
    """The loader of whole documents: nested events and flat rows in JSON, and CSV."""
    from rungwise.sources.tables import load_candidates

    first, second = row(1), row(2)
    shared = {k: first.pop(k) for k in ("eventId", "endDate", "split")}
    (tmp_path / "nested.json").write_text(json.dumps({"events": [shared | {"markets": [first, first | {"conditionId": f"0x{9:064x}"}]}]}))
    (tmp_path / "flat.json").write_text(json.dumps({"rows": [second, row(3, split="")]}, indent=1))
    (tmp_path / "flat.csv").write_text("\n".join([",".join(HEADER), ",".join(row(4).values())]))

    def load(name):
        return sorted((r.event_id, int(r.condition_id, 16), r.candidate, tuple(r.problems)) for r in load_candidates(spark, str(tmp_path / name)).collect())

    assert load("nested.json") == [("e1", 1, 1.0, ()), ("e1", 9, 1.0, ())]
    assert load("flat.json") == [("e2", 2, 0.0, ()), ("e3", 3, 1.0, ("missing_split",))]
    assert load("flat.csv") == [("e4", 4, 0.0, ())]
