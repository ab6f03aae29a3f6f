"""Bindings between documents: digests, texts and counts, from JSON and from counted rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from rungwise.operators import bindings

SCHEMA = "binding string, kind string, left_document string, left_path string, right_document string, right_path string"
GOOD = hashlib.sha256(b"archive").hexdigest()


def documents(spark, **changes):
    manifest = {"files": {"rows.csv": {"rows": 3, "sha256": GOOD}}, "commit": "ab", "empty": ""} | changes
    other = {"bound": {"sha256": GOOD, "commit": "ab", "rows": "3"}, "empty": ""}
    rows = [("manifest", json.dumps(manifest)), ("report", json.dumps(other)), ("broken", "{not json"), ("none", None)]
    return spark.createDataFrame(rows, "document string, body string")


def counted(spark):
    rows = spark.createDataFrame([("rows.csv", "a"), ("rows.csv", "b"), ("rows.csv", "b"), (None, "c")], "file string, event string")
    return bindings.measured(rows, "file", {"rows": F.count(F.lit(1)), "events": F.countDistinct("event")})


def found(spark, rows, **changes):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.key, r.rule_id) for r in bindings.problems(df, documents(spark, **changes), counted(spark)).collect()}


ALL = [
    ("digest", "digest", "manifest", "$.files['rows.csv'].sha256", "report", "$.bound.sha256"),
    ("rows", "count", "manifest", "$.files['rows.csv'].rows", "rows.csv", "rows"),
    ("rows again", "count", "report", "$.bound.rows", "rows.csv", "rows"),
    ("commit", "text", "manifest", "$.commit", "report", "$.bound.commit"),
    ("empty", "text", "manifest", "$.empty", "report", "$.empty"),
]


def test_all_hold(spark):
    assert found(spark, ALL + ALL[:2]) == set()


def test_a_wrong_count_digest_and_text(spark):
    assert found(spark, ALL, commit="cd") == {("commit", "binding_differs")}
    for value, rule in [(4, "binding_differs"), (-3, "count_not_whole"), (3.0, "count_not_whole"), ("03", "count_not_whole"), (True, "count_not_whole"), (None, "left_side_absent")]:
        assert found(spark, ALL, files={"rows.csv": {"rows": value, "sha256": GOOD}}) == {("rows", rule)}, value
    assert found(spark, ALL, files={"rows.csv": {"rows": 3, "sha256": GOOD.upper()}}) == {("digest", "digest_malformed")}


def test_absent_sides_and_odd_bindings(spark):
    rows = [
        ("a", "count", "manifest", "$.nothing", "rows.csv", "rows"), ("b", "count", "manifest", "$.files['rows.csv'].rows", "rows.csv", "markets"),
        ("c", "text", "gone", "$.x", "report", "$.empty"), ("d", "text", "broken", "$.x", "none", "$.x"), ("e", "size", "manifest", "$.commit", "manifest", "$.commit"),
        (None, "text", "manifest", "$.commit", "report", "$.empty"), ("f", "text", "manifest", None, "report", "$.empty"),
        ("g", "count", "rows.csv", "rows", "rows.csv", "events"),
    ]
    assert found(spark, rows) == {
        ("a", "left_side_absent"), ("b", "right_side_absent"), ("c", "left_side_absent"), ("d", "left_side_absent"),
        ("e", "binding_of_unknown_kind"), ("", "binding_differs"), ("f", "left_side_absent"), ("g", "binding_differs"),
    }


def test_nothing_to_bind(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bindings.problems(df, documents(spark)).count() == 0
    one = spark.createDataFrame(ALL[1:2], SCHEMA)
    assert [r.rule_id for r in bindings.problems(one, documents(spark)).collect()] == ["right_side_absent"]
