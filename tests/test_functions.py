from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rungwise.functions import chain, documents, numeric, text, times
from rungwise.operators import quality


def one(spark, value, function, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(function("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        # The unit words and signs, each with the factor it must have.
        ("$0.75M", 7.5e5),
        ("over 14,200 thousand", 1.42e7),
        ("≥ -0.5k", -500.0),
        ("4e2", 400.0),
        ("7.25%", 0.0725),
        ("140 bps", 0.014),
        ("£9 billion+", 9e9),
        ("+11 percentage points", 0.11),
        ("2 trillion", 2e12),
        # No unit, no single number, or none that is finite.
        ("8 kilo", 8.0),
        ("", None),
        ("no number", None),
        ("between 3 and 4", None),
        ("2031-12-24", None),
        ("v7.9", None),
        ("2e400", None),
    ],
)
def test_threshold(spark, raw, value):
    got = one(spark, raw, text.threshold)
    assert got is None if value is None else got == pytest.approx(value)


def test_template_replaces_the_first_gap_literally(spark):
    df = spark.createDataFrame([("A ___ b ___", "$1"), ("none", "x"), ("A ___", None)], "t string, g string")
    got = [r.y for r in df.select(text.fill_template("t", "g").alias("y")).collect()]
    assert got == ["A $1 b ___", "none", None]


def test_names_are_normalised_before_the_check(spark):
    df = spark.createDataFrame([], "outcomePrices int, `final-volume` int, liquidityNum int, closedTime int, p int")
    with pytest.raises(quality.DataQualityError) as error:
        quality.assert_safe_features(df)
    assert "'p'" not in str(error.value) and "closedTime" in str(error.value)
    quality.assert_safe_features(df.select("p"))
    with pytest.raises(quality.DataQualityError):
        quality.assert_safe_features(df.select("p"), ["P"])


@pytest.mark.parametrize(
    ("raw", "strict", "zoned"),
    [
        ("2026-06-01T00:00:00Z", 1780272000, 1780272000),
        ("2026-06-01T00:00:00+00:00", 1780272000, 1780272000),
        ("2026-06-01T02:00:00+02:00", None, 1780272000),
        ("2026-06-01T00:00:00", None, None),
        ("not-a-time", None, None),
    ],
)
def test_timestamps_need_a_zone(spark, raw, strict, zoned):
    assert one(spark, raw, lambda c: F.unix_seconds(times.utc_timestamp(c))) == strict
    assert one(spark, raw, lambda c: F.unix_seconds(times.zoned_timestamp(c))) == zoned


@pytest.mark.parametrize(
    ("first", "last", "span", "ranges"),
    [
        (10, 17, 3, [(10, 12), (12, 14), (14, 16), (16, 17)]),
        (8, 8, 2, [(8, 8)]),
        (10, 12, 3, [(10, 12)]),
        (10, 14, 3, [(10, 12), (12, 14)]),
        (5, 4, 3, []),
    ],
)
def test_block_ranges(spark, first, last, span, ranges):
    df = spark.createDataFrame([(first, last)], "a long, b long")
    got = df.select(times.block_ranges("a", "b", span).alias("r")).first().r
    assert [tuple(r) for r in got] == ranges


def test_daily_windows_end_early(spark):
    df = spark.createDataFrame(
        [("2026-06-01 00:00:00", "2026-06-02 12:00:00"), ("2026-06-01 00:00:00", "2026-06-01 00:00:00")], "a string, b string"
    )
    got = df.select(times.daily_windows(F.to_timestamp("a"), F.to_timestamp("b")).alias("w")).collect()
    assert [(w.end - w.start).total_seconds() for w in got[0].w] == [86_400, 43_200]
    assert got[1].w is None


def test_overlapping_splits_are_an_error(spark):
    windows = {"a": ("2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z"), "b": ("2026-02-01T00:00:00Z", "2026-04-01T00:00:00Z")}
    df = spark.sql("select timestamp'2026-03-01' as x, timestamp'2026-02-15' as bad")
    assert df.select(times.split_of("x", windows).alias("s")).first().s == "b"
    with pytest.raises(Exception, match="multiple splits"):
        df.select(times.split_of("bad", windows)).collect()


def words(*values):
    return "0x" + "".join(f"{v:064x}" for v in values)


@pytest.mark.parametrize(
    ("data", "payout"),
    [
        (words(2, 64, 2, 1, 0), ["1", "0"]),
        (words(3, 64, 3, 3, 2, 1), ["3", "2", "1"]),
        (words(2, 64, 2, 2**60, 2**256 - 1), [str(2**60), str(2**256 - 1)]),
        (words(2, 96, 2, 1, 0), None),
        (words(2, 64, 2, 1, 0) + "00" * 32, None),
        (words(2, 64, 1, 1), None),
        (words(2, 64, 2, 1, 0)[:-2], None),
        ("0xzz", None),
        (words(0, 64, 0), None),
        (None, None),
    ],
)
def test_payload(spark, data, payout):
    got = one(spark, data, chain.resolution_payload)
    assert (got and list(got.payouts)) == payout
    if payout:
        assert got.slot_count == len(payout)


@pytest.mark.parametrize(("raw", "value"), [("0x0", 0), ("0xff", 255), ("0x00", None), ("0x", None), ("12", None), ("0xg", None)])
def test_quantity(spark, raw, value):
    assert one(spark, raw, chain.quantity) == value


def test_quantities_of_any_width(spark):
    values = [0, 1, 2**60 - 1, 2**60, 2**63 - 1, 2**63, 2**64, 10**9, 10**18, 10**77, 2**256 - 1, *(3**k for k in range(0, 160, 13))]
    rows = spark.createDataFrame([(hex(v), str(v), v if v < 2**63 else None) for v in values], "h string, t string, n long")
    wrong = ~chain.quantity_text("h").eqNullSafe(F.col("t")) | ~chain.quantity("h").eqNullSafe(F.col("n"))
    assert rows.where(wrong).count() == 0


def test_evidence_digest(spark):
    a, b = hashlib.sha256(b"a").hexdigest(), hashlib.sha256(b"b").hexdigest()
    want = hashlib.sha256(b"domain\x00" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(chain.evidence_digest("domain\x00", "a", "b").alias("d")).first().d == want


@pytest.mark.parametrize(("x", "y"), [(0.12345678901249, 0.123456789012), (-1e-15, 0.0), (2.5, 2.5)])
def test_quantised(spark, x, y):
    got = one(spark, x, numeric.quantised, "double")
    assert got == y and math.copysign(1, got) == math.copysign(1, y)


def test_quantised_refuses_infinity(spark):
    with pytest.raises(Exception, match="not finite"):
        one(spark, float("inf"), numeric.quantised, "double")


def test_sigmoid_and_softplus_do_not_overflow(spark):
    assert one(spark, -800.0, numeric.sigmoid, "double") == 0.0
    assert one(spark, 800.0, numeric.sigmoid, "double") == 1.0
    assert one(spark, 800.0, numeric.softplus, "double") == 800.0


@pytest.mark.parametrize(
    ("raw", "size"), [('["Yes","No"]', 2), ("[]", 0), ('{"a":1}', None), ("5", None), ("[1,", None), (None, None)]
)
def test_json_list(spark, raw, size):
    got = one(spark, raw, documents.json_list)
    assert (None if got is None else len(got)) == size


@pytest.mark.parametrize(
    ("path", "safe"),
    [
        ("raw/clob/event_1/batch.json.gz", True),
        ("raw/gamma/event_1.json.gz", False),
        ("/raw/clob/x.json.gz", False),
        ("raw/clob/../x.json.gz", False),
        ("raw/clob//x.json.gz", False),
        ("raw/clob/./x.json.gz", False),
        ("raw/clob/x.json", False),
        (None, False),
    ],
)
def test_archive_paths(spark, path, safe):
    assert one(spark, path, lambda c: documents.safe_archive_path(c, F.lit("clob"))) is safe


PAGE = "https://e.test/pages"
GOOD = PAGE + "?closed=true&end_date_max=2026-06-02T00%3A00%3A00Z&end_date_min=2026-06-01T00%3A00%3A00Z&limit=100&title_search=above"


@pytest.mark.parametrize(
    ("url", "ok"),
    [
        (GOOD, True),
        (GOOD + "&after_cursor=abc", True),
        (GOOD + "&after_cursor=", False),
        (GOOD + "&limit=100", False),
        (GOOD + "&other=1", False),
        (GOOD + "#part", False),
        (GOOD.replace("limit=100", "limit=50"), False),
        (GOOD.replace("06-02T", "06-03T"), False),
        (GOOD.replace("e.test", "f.test"), False),
        (GOOD.replace("&title_search=above", ""), False),
        (None, False),
    ],
)
def test_page_urls(spark, url, ok):
    assert one(spark, url, lambda c: documents.page_request_ok(c, PAGE, "above")) is ok


BODY = '{"end_ts":2700,"fidelity":1,"markets":["1","2"],"start_ts":0}'


@pytest.mark.parametrize(
    ("body", "ok"),
    [
        (BODY, True),
        (BODY.replace('"2"', '"1"'), False),
        (BODY.replace('"2"', '"x"'), False),
        (BODY.replace("2700", "2701"), False),
        (BODY.replace('"fidelity":1', '"fidelity":2'), False),
        (BODY.replace('["1","2"]', "[]"), False),
        (BODY.replace('"start_ts":0', '"start_ts":0,"interval":"1h"'), False),
    ],
)
def test_history_bodies(spark, body, ok):
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert one(spark, body, lambda c: documents.history_request_ok(c, F.lit(digest), 1, 2700)) is ok
    assert one(spark, body, lambda c: documents.history_request_ok(c, F.lit("0" * 64), 1, 2700)) is False


def test_identifier_order_is_numeric_before_text(spark):
    ids = ["b", "10", "9", "a", "0100", "123456789012345678901234567890", "99"]
    df = spark.createDataFrame([(i,) for i in ids], "x string")
    got = [r.x for r in df.orderBy(*text.identifier_order("x")).collect()]
    assert got == ["9", "10", "99", "0100", "123456789012345678901234567890", "a", "b"]


@pytest.mark.parametrize(
    "text",
    ['["Yes","No"]', '[""]', '["",""]', '["a,b","]["]', '["é","𝒳"]', "[]", '["a", "b"]', '["a\\"","b"]', '["a"', '["a""b"]',
     '["a\nb"]', '["a"]\n', '[1,2]', '[null]', ' ["a"]', '{"a":1}', "none", "", '["a"],["b"]', None],
)
def test_plain_lists_are_cut_as_they_would_be_parsed(spark, text):
    from rungwise.functions.documents import json_list

    given = spark.createDataFrame([(text,)], "text string")
    parsed = F.when(F.col("text").rlike(r"^\s*\["), F.from_json("text", "array<string>"))
    row = given.select(json_list("text").alias("cut"), parsed.alias("parsed")).first()
    assert row["cut"] == row["parsed"]
