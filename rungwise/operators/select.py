"""Eligibility of nested events and their markets, deduplication and canonical order.

Markets arrive nested in their event row, so every per-event rule is an array expression on that
row: selection needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.config import Protocol
from rungwise.functions.documents import json_list, terminal_label
from rungwise.functions.text import (
    asset_of_title,
    decimal_text,
    fill_template,
    identifier_order,
    threshold,
)
from rungwise.functions.times import split_of, utc_day, utc_text, zoned_timestamp
from rungwise.session import checkpointed
from rungwise.operators.ordered import MAX_GROUP_ROWS, segment, with_index, with_next

MARKET_FIELDS = (
    "id string, conditionId string, question string, groupItemTitle string, endDate string, "
    "closed boolean, enableOrderBook boolean, umaResolutionStatus string, outcomes string, "
    "outcomePrices string, clobTokenIds string"
)
EVENT_FIELDS = (
    "id string, title string, endDate string, closed boolean, "
    f"markets array<struct<{', '.join(f.replace(' ', ':', 1) for f in MARKET_FIELDS.split(', '))}>>"
)


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def _not(test: Column) -> Column:
    """Negation in which an unknown test counts as failed."""
    return ~F.coalesce(test, F.lit(False))


def _reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that fire, in declared order."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))


def event_reasons(protocol: Protocol, end: str | Column) -> Column:
    """Event-level rejection reasons; every rule is reported, none stops the others."""
    title = F.col("title")
    end = F.col(end) if isinstance(end, str) else end
    lower, upper = (F.to_timestamp(F.lit(t)) for t in protocol.discovery)
    named, dated = title.isNotNull(), end.isNotNull()
    rules = [
        ("missing_event_title", ~named),
        (
            "event_title_regex_mismatch",
            named & ~title.rlike(rf"^(?:{protocol.title_regex})\z"),
        ),
        (
            "local_title_search_mismatch",
            named & ~F.contains(F.lower(title), F.lit(protocol.title_search.lower())),
        ),
        ("asset_not_allowed", named & asset_of_title(title, protocol.assets).isNull()),
        ("event_not_closed", _not(F.col("closed"))),
        ("invalid_event_end_date", ~dated),
        ("event_outside_discovery_half_open_interval", dated & ~((end >= lower) & (end < upper))),
        ("event_not_in_any_split", dated & split_of(end, protocol.splits).isNull()),
        ("missing_nested_markets", F.col("markets").isNull()),
    ]
    return _reasons(rules)


def _parsed_market(market: Column) -> Column:
    """Every text of a market parsed once; the rules below only read the parsed fields."""
    group = market["groupItemTitle"]
    return F.struct(
        F.trim(market["id"]).alias("market_id"),
        market["conditionId"].alias("condition_id"),
        market["question"].alias("question"),
        group.alias("group"),
        threshold(group).alias("level"),
        zoned_timestamp(market["endDate"]).alias("end"),
        market["closed"].alias("closed"),
        market["enableOrderBook"].alias("order_book"),
        market["umaResolutionStatus"].alias("resolution"),
        json_list(market["outcomes"]).alias("outcomes"),
        F.transform(json_list(market["outcomePrices"]), lambda x: x.try_cast("double")).alias(
            "prices"
        ),
        F.transform(json_list(market["clobTokenIds"]), lambda t: F.trim(t)).alias("tokens"),
    )


def _market_decision(parsed: Column, protocol: Protocol) -> Column:
    """Rejection reasons and contract fields. ``_end`` is the event's parsed end."""
    group, level, end = parsed["group"], parsed["level"], parsed["end"]
    outcomes, prices, tokens = parsed["outcomes"], parsed["prices"], parsed["tokens"]
    prices_ok = F.coalesce(
        (F.size(prices) == 2)
        & ~F.exists(prices, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        F.lit(False),
    )
    tokens_ok = (
        (F.size(tokens) == 2)
        & (tokens[0] != tokens[1])
        & decimal_text(tokens[0])
        & decimal_text(tokens[1])
    )
    label = terminal_label(prices)
    wanted = F.array(*[F.lit(o) for o in protocol.required_outcomes])
    rules = [
        ("missing_market_id", _blank(parsed["market_id"])),
        ("missing_condition_id", _blank(parsed["condition_id"])),
        ("missing_group_item_title", _blank(group)),
        ("invalid_group_item_threshold", ~_blank(group) & level.isNull()),
        (
            "question_does_not_match_event_template",
            _not(parsed["question"] == fill_template("title", group)),
        ),
        ("market_not_closed", _not(parsed["closed"])),
        ("order_book_not_enabled", _not(parsed["order_book"])),
        (
            "resolution_status_mismatch",
            _not(parsed["resolution"] == protocol.required_resolution_status),
        ),
        ("invalid_market_end_date", end.isNull()),
        ("market_end_does_not_match_event_end", end.isNotNull() & _not(end == F.col("_end"))),
        ("invalid_outcomes", outcomes.isNull()),
        ("outcomes_mismatch", outcomes.isNotNull() & _not(outcomes == wanted)),
        ("invalid_outcome_prices", ~prices_ok),
        ("non_terminal_gamma_outcome_prices", prices_ok & label.isNull()),
        ("invalid_clob_token_ids", _not(tokens_ok)),
    ]
    return F.struct(
        parsed["market_id"].alias("market_id"),
        _reasons(rules).alias("reasons"),
        parsed["condition_id"].alias("condition_id"),
        parsed["question"].alias("question"),
        level.alias("threshold"),
        label.alias("label"),
        F.try_element_at(tokens, F.lit(1)).alias("yes_token"),
        F.try_element_at(tokens, F.lit(2)).alias("no_token"),
    )


def _has_copies(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def select_events(events: DataFrame, protocol: Protocol, keep: Sequence[str] = ()) -> DataFrame:
    """Decide every event and nested market. Columns of ``keep`` are passed on.

    Adds ``event_id, asset, split, event_end, decisions, candidates, reasons, status``. Markets
    are judged only when no event-level rule fired; an event survives only whole.
    """
    parsed = F.transform("markets", lambda m: _parsed_market(m))
    base = (
        events.withColumn("_end", zoned_timestamp("endDate"))
        .withColumn("event_reasons", event_reasons(protocol, "_end"))
        .withColumn("_parsed", F.when(F.size("event_reasons") == 0, parsed))
        .withColumn(
            "decisions", F.transform("_parsed", lambda m: _market_decision(m, protocol))
        )
    )
    base = base.withColumn(
        "candidates", F.filter("decisions", lambda d: F.size(d["reasons"]) == 0)
    )
    judged = F.col("decisions").isNotNull()
    kept = F.col("candidates")
    tokens = F.concat(kept["yes_token"], kept["no_token"])
    late = _reasons(
        [
            ("duplicate_thresholds_after_market_filter", judged & _has_copies(kept["threshold"])),
            ("duplicate_market_ids_after_market_filter", judged & _has_copies(kept["market_id"])),
            ("duplicate_token_ids_after_market_filter", judged & _has_copies(tokens)),
            (
                "too_few_strictly_eligible_markets",
                judged & (F.size(kept) < protocol.minimum_thresholds),
            ),
            (
                "nested_market_failed_strict_filter",
                judged & (F.size(kept) != F.size("markets")),
            ),
        ]
    )
    reasons = F.concat(F.col("event_reasons"), late)
    end = F.col("_end")
    extra = [c for c in ("source_event_sha256",) if c in events.columns]
    return base.select(
        F.trim("id").alias("event_id"),
        F.col("title").alias("event_title"),
        end.alias("event_end"),
        asset_of_title("title", protocol.assets).alias("asset"),
        split_of(end, protocol.splits).alias("split"),
        F.greatest(F.size("markets"), F.lit(0)).cast("bigint").alias("total_nested_market_count"),
        F.greatest(F.size("candidates"), F.lit(0)).cast("bigint").alias("eligible_market_count"),
        "decisions",
        "candidates",
        reasons.alias("reasons"),
        F.when(F.size(reasons) == 0, "selected").otherwise("rejected").alias("status"),
        *extra,
        *keep,
    )


def event_decisions(selected: DataFrame) -> DataFrame:
    return selected.drop("decisions", "candidates")


def _computed_once(array: str, when: Column | None = None) -> Column:
    """Generator input that is not a bare column.

    For a bare column Spark infers a size filter and pushes it below the projection, where the
    whole eligibility expression would be evaluated a second time.
    """
    return F.when(F.col(array).isNotNull() if when is None else when, F.col(array))


def market_decisions(selected: DataFrame) -> DataFrame:
    decided = selected.select("event_id", F.explode(_computed_once("decisions")).alias("d"))
    passed = F.size("d.reasons") == 0
    return decided.select(
        "event_id",
        "d.market_id",
        "d.reasons",
        F.when(passed, "passed").otherwise("rejected").alias("status"),
    )


def contracts(selected: DataFrame) -> DataFrame:
    """Strict contracts of the selected events, one row per market."""
    keep = ["event_id", "event_title", "event_end", "asset", "split"]
    keep += [c for c in ("source_event_sha256",) if c in selected.columns]
    whole = _computed_once("candidates", F.col("status") == "selected")
    fields = ["market_id", "condition_id", "question", "threshold", "label", "yes_token", "no_token"]
    return selected.select(*keep, F.explode(whole).alias("c")).select(
        *keep, *[f"c.{name}" for name in fields], F.col("c.yes_token").alias("token")
    )


def reason_counts(decisions: DataFrame) -> DataFrame:
    return (
        decisions.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def selection_view(markets: str | Column = "markets") -> Column:
    """The decision-relevant part of an event as JSON text, followed by its markets in canonical order."""
    head = F.to_json(F.struct("id", "title", "endDate", "closed"), {"ignoreNullFields": "false"})
    listed = F.array_join(F.sort_array(F.transform(markets, lambda m: F.to_json(m))), ",", "null")
    return F.concat(head, F.coalesce(F.concat(F.lit("["), listed, F.lit("]")), F.lit("null")))


def selection_fingerprint(markets: str | Column = "markets") -> Column:
    return F.sha2(selection_view(markets), 256)


def first_seen(pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per event id over overlapping pages.

    ``pages`` holds ``id``, the ``order`` columns, ``selection`` and ``full`` fingerprints and the
    ``payload`` to keep. Copies are counted per distinct content before ids meet, so a much
    repeated event shrinks map-side. ``changed`` marks ids whose decision-relevant content differs.
    """
    return per_id(contents_of(pages, order))


def contents_of(pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """(id, selection, full, n, seen, payload): one row per distinct content, first seen at ``seen``."""
    position = F.struct(*order)
    return pages.groupBy("id", "selection", "full").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(position).alias("seen"),
        F.min_by("payload", position).alias("payload"),
    )


def merged_contents(contents: DataFrame) -> DataFrame:
    """Contents counted in several places, as if they had been counted in one."""
    return contents.groupBy("id", "selection", "full").agg(
        F.sum("n").alias("n"), F.min("seen").alias("seen"), F.min_by("payload", "seen").alias("payload")
    )


def per_id(contents: DataFrame) -> DataFrame:
    """What ``first_seen`` reports, from distinct contents."""
    return contents.groupBy("id").agg(
        F.min_by("payload", "seen").alias("payload"),
        (F.sum("n") - 1).alias("duplicates"),
        (F.sum("n") - F.min_by("n", "seen")).alias("unused_field_changes"),
        (F.min("selection") != F.max("selection")).alias("changed"),
    )


def union_windows(windows: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of overlapping windows; rows on a shared border are kept once."""
    merged = windows[0]
    for window in windows[1:]:
        merged = merged.unionByName(window)
    payload = F.struct(*[c for c in merged.columns if c != key])
    return (
        merged.groupBy(key)
        .agg(
            F.min(payload).alias("v"),
            F.count(F.lit(1)).alias("copies"),
            (F.min(payload) != F.max(payload)).alias("conflict"),
        )
        .select(key, "v.*", "copies", "conflict")
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlapping_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    name: str,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Neighbouring intervals (by start, end, name) of which the later starts too early."""
    placed = df.select(*keys, start, end, name).withColumn("_at", F.struct(start, end, name))
    paired = with_next(segment(placed, list(keys), "_at", max_rows), "_at", "_next")
    return paired.where(F.col(f"_next.{start}") < F.col(end)).select(
        *keys, F.col(name).alias("left"), F.col(f"_next.{name}").alias("right")
    )


def request_batches(
    rows: DataFrame,
    event: str,
    token: str,
    order: str,
    end: str,
    window_seconds: int,
    size: int = 20,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """History request plan: up to ``size`` tokens of one event per request, along ``order``."""
    placed = rows.select(event, token, order, end)
    numbered = with_index(segment(placed, [event], order, max_rows), "_index")
    end_ts = F.unix_seconds(F.max(end))
    return (
        numbered.groupBy(event, F.floor(F.col("_index") / size).alias("batch_index"))
        .agg(
            F.array_sort(F.collect_list(F.struct(order, token)))[token].alias("tokens"),
            end_ts.alias("end_ts"),
        )
        .withColumn("start_ts", F.col("end_ts") - window_seconds)
    )


def canonical_keys(splits: Mapping[str, tuple[str, str]]) -> list[Column | str]:
    """Split, time, id (numeric ids first), longest horizon, threshold, market."""
    position = None
    for index, name in enumerate(splits):
        test = F.col("split") == name
        position = F.when(test, index) if position is None else position.when(test, index)
    return [
        position,
        "scheduled_time",
        *identifier_order("event_id"),
        F.desc("horizon_seconds"),
        "threshold",
        "market_id",
    ]


def canonical_order(rows: DataFrame, splits: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows in the order of ``canonical_keys``."""
    return rows.orderBy(*canonical_keys(splits))


def with_position(ordered: DataFrame, name: str) -> DataFrame:
    """Number the rows of a sorted table from 0, without gathering it: each range partition numbers
    its own rows, and the counts before it (one row per partition) are added."""
    marked = checkpointed(
        ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    )
    inside = F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return marked.join(offsets, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_id", "_before")


def snapshot_rows(retained: DataFrame, label_source: str) -> DataFrame:
    """The closed 23-column candidate schema from retained cutoff rows."""
    return retained.select(
        "event_id",
        "market_id",
        "condition_id",
        "asset",
        utc_text("event_end").alias("scheduled_time"),
        utc_day("event_end").alias("utc_day"),
        "split",
        "horizon_seconds",
        utc_text("cutoff").alias("cutoff_time"),
        "threshold",
        F.col("label").alias("gamma_candidate_label"),
        "yes_token",
        F.col("p").alias("reference_probability"),
        utc_text("point_ts").alias("reference_timestamp"),
        "staleness_seconds",
        "source_event_sha256",
        "source_history_sha256",
        "event_title",
        "question",
        "no_token",
        "event_horizon_contract_count",
        F.lit(label_source).alias("gamma_candidate_label_source"),
        F.lit("False").alias("gamma_candidate_label_onchain_verified"),
    )
