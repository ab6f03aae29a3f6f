"""Nested JSON: event pages with markets, candidate documents and price-history maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.operators.select import EVENT_FIELDS

HISTORY_SCHEMA = "history map<string, array<struct<t:string, p:string>>>"


def event_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per event of each page; other columns of ``pages`` are kept.

    Markets stay nested: selection decides an event on its own row. ``canonical`` is the whole
    event with sorted keys, unused fields included.
    """
    rest = [c for c in pages.columns if c != body]
    listed = pages.select(
        *rest,
        F.sha2(F.col(body), 256).alias("source_event_sha256"),
        F.posexplode(F.from_json(body, "events array<string>")["events"]).alias("position", "raw"),
    )
    return listed.select(
        *rest,
        "source_event_sha256",
        "position",
        F.to_json(F.parse_json("raw")).alias("canonical"),
        # A generator's input is computed once, however many of its fields are read.
        F.inline(F.array(F.from_json("raw", EVENT_FIELDS))),
    )


def flatten_candidates(document: DataFrame) -> DataFrame:
    """Rows of a candidate document.

    ``rows``, ``candidates`` or ``markets`` hold flat rows; otherwise ``events`` are flattened and
    a market field wins over the event field of the same name.
    """
    for name in ("rows", "candidates", "markets"):
        if name in document.columns:
            return document.select(F.inline(name))
    if "events" not in document.columns:
        return document
    events = document.select(F.inline("events"))
    market_type = events.schema["markets"].dataType.elementType
    own = set(market_type.names)
    outer = [c for c in events.columns if c != "markets" and c not in own]
    return events.select(*outer, F.inline("markets"))


def market_rows(events: DataFrame) -> DataFrame:
    """Flat (event, market) rows of nested events."""
    return events.select(
        F.col("id").alias("event_id"),
        F.col("title").alias("event_title"),
        F.col("endDate").alias("event_end_date"),
        F.col("closed").alias("event_closed"),
        F.explode("markets").alias("m"),
    ).select("event_id", "event_title", "event_end_date", "event_closed", "m.*")


def history_points(documents: DataFrame, body: str = "body") -> DataFrame:
    """``token, ts, p`` points of price-history documents, with the digest of the document.

    ``t`` must be integral and ``p`` numeric in [0, 1]; booleans are rejected. ``problem`` names
    what is wrong with a point and is null for a usable one.
    """
    parsed = documents.select(
        F.sha2(F.col(body), 256).alias("source_history_sha256"),
        F.from_json(body, HISTORY_SCHEMA).alias("doc"),
    )
    exploded = parsed.select(
        "source_history_sha256", F.explode("doc.history").alias("token", "points")
    ).select("source_history_sha256", "token", F.explode("points").alias("point"))
    t, p = F.col("point.t"), F.col("point.p")
    boolean = F.lower(t).isin("true", "false") | F.lower(p).isin("true", "false")
    # A whole float such as 12.0 counts as integral.
    seconds = F.when(t.rlike(r"^\s*-?\d+(\.0+)?\s*$"), t.try_cast("double").cast("bigint"))
    value = p.try_cast("double")
    problem = (
        F.when(F.col("point").isNull(), "not_an_object")
        .when(F.coalesce(boolean, F.lit(False)), "boolean_data")
        .when(t.isNull() | p.isNull() | value.isNull(), "invalid_t_or_p")
        .when(seconds.isNull(), "timestamp_not_integral")
        .when(F.isnan(value) | (value < 0) | (value > 1), "out_of_range")
    )
    return exploded.select(
        "token",
        F.timestamp_seconds(seconds).alias("ts"),
        value.alias("p"),
        "source_history_sha256",
        problem.alias("problem"),
    )


def requested_series(tokens: DataFrame, points: DataFrame) -> DataFrame:
    """Requested tokens with the number of their points; an absent token is an empty series."""
    counted = points.groupBy("token").agg(F.count(F.lit(1)).alias("points"))
    return tokens.select("token").distinct().join(counted, "token", "left").select(
        "token", F.coalesce("points", F.lit(0)).cast("bigint").alias("points")
    )
