"""Fail-closed data rules. Each yields ``(rule_id, key, detail)`` rows; none means clean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.config import Protocol
from rungwise.functions.chain import is_digest, is_hex32
from rungwise.functions.numeric import is_finite
from rungwise.functions.text import FORBIDDEN_FEATURES, decimal_text, snake_name
from rungwise.functions.times import utc_day
from rungwise.operators.ordered import MAX_GROUP_ROWS, segment, with_next
from rungwise.session import written

MICROS = 1_000_000
VIOLATION = "rule_id string, key string, detail string"


class DataQualityError(AssertionError):
    """At least one fail-closed rule fired."""


def no_violations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VIOLATION)


def assert_clean(violations: DataFrame, show: int = 20) -> None:
    """Raise with a few examples if any violation exists."""
    found = violations.limit(show).collect()
    if found:
        lines = [f"{row['rule_id']} [{row['key']}] {row['detail']}" for row in found]
        raise DataQualityError("; ".join(lines))


def key_text(*names: str) -> Column:
    return F.concat_ws("|", *[F.col(n).cast("string") for n in names])


def _violations(df: DataFrame, rule: str, key: Column, detail: Column | str = "") -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule_id"), key.alias("key"), text.alias("detail"))


def row_rules(df: DataFrame, rules: Mapping[str, Column], key: Column) -> DataFrame:
    """All row rules in one pass. A rule names what is wrong; an unknown test counts as wrong.

    Rules that hold leave nulls, dropped as rows: a lambda over the array would have every rule
    interpreted row by row instead of compiled.
    """
    marks = F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()])
    fired = df.select(key.alias("key"), F.explode(marks).alias("rule_id")).where("rule_id is not null")
    return fired.select("rule_id", "key", F.lit("").alias("detail"))


def _common_rules() -> dict[str, Column]:
    p = F.col("reference_probability")
    return {
        "non_finite_threshold": ~is_finite("threshold"),
        "non_binary_label": ~F.col("label").isin(0.0, 1.0),
        "probability_outside_unit_interval": ~(is_finite(p) & (p >= 0) & (p <= 1)),
        "non_positive_horizon": F.col("horizon_seconds") <= 0,
        "negative_staleness": F.col("staleness_seconds") < 0,
        "non_positive_contract_count": F.col("event_horizon_contract_count") <= 0,
        "non_decimal_yes_token": ~decimal_text("yes_token"),
        "bad_source_event_digest": ~is_digest("source_event_sha256"),
        "bad_source_history_digest": ~is_digest("source_history_sha256"),
        "bad_condition_id": ~is_hex32("condition_id"),
        "bad_timestamp": F.col("scheduled_time").isNull()
        | F.col("cutoff_time").isNull()
        | F.col("reference_timestamp").isNull(),
    }


def _empty_identifier(*names: str) -> Column:
    return F.exists(
        F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]),
        lambda value: value == "",
    )


def evidence_row_rules() -> dict[str, Column]:
    yes = F.col("label") == 1.0
    vector = F.when(yes, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return _common_rules() | {
        "empty_identifier": _empty_identifier(
            "event_id", "market_id", "condition_id", "asset", "split", "utc_day", "yes_token"
        ),
        "negative_chain_coordinate": (F.col("resolution_block_number") < 0)
        | (F.col("resolution_log_index") < 0),
        "bad_chain_source_digest": ~is_digest("chain_source_sha256"),
        "bad_block_hash": ~is_hex32("resolution_block_hash"),
        "bad_transaction_hash": ~is_hex32("resolution_tx_hash"),
        "label_payout_disagreement": ~(F.col("payout_vector") == vector),
        "label_candidate_disagreement": F.col("gamma_candidate_label")
        != F.when(yes, "Yes").otherwise("No"),
    }


def snapshot_row_rules(label_source: str) -> dict[str, Column]:
    return _common_rules() | {
        "empty_identifier": _empty_identifier(
            "event_id", "market_id", "asset", "split", "utc_day", "yes_token"
        ),
        "unexpected_label_source": F.col("gamma_candidate_label_source") != label_source,
        "onchain_flag_not_false": F.col("gamma_candidate_label_onchain_verified") != "False",
    }


ROW_KEY = ("event_id", "market_id", "horizon_seconds")


def evidence_row_violations(df: DataFrame) -> DataFrame:
    return row_rules(df, evidence_row_rules(), key_text(*ROW_KEY))


def snapshot_row_violations(df: DataFrame, label_source: str) -> DataFrame:
    return row_rules(df, snapshot_row_rules(label_source), key_text(*ROW_KEY))


@dataclass(frozen=True)
class KeyRule:
    """What every key of a table must keep to.

    ``fields``: the key determines them. ``once``: it occurs once. ``rising`` (threshold, label): no
    label 0 lies at or below a label 1.
    """

    rule: str
    keys: tuple[str, ...]
    fields: tuple[str, ...] = ()
    once: bool = False
    rising: tuple[str, str] | None = None


def _plain(df: DataFrame, name: str) -> Column:
    """The column with one zero and one NaN, as grouping by it would have."""
    value = F.col(name)
    if dict(df.dtypes)[name] not in ("double", "float"):
        return value
    return F.when(F.isnan(value), F.lit(float("nan"))).when(value == 0.0, F.lit(0.0)).otherwise(value)


def _digest(df: DataFrame, names: Sequence[str]) -> Column:
    """64 bits of the values, nulls marked."""
    return F.xxhash64(*[part for name in names for part in (_plain(df, name), F.col(name).isNull())])


def _key_columns(rules: Sequence[KeyRule]) -> list[str]:
    return list(dict.fromkeys(k for rule in rules for k in rule.keys))


def key_facts(df: DataFrame, rules: Sequence[KeyRule], keep: Sequence[str] = ()) -> DataFrame:
    """What the rules read of a row: keys, thresholds and labels, and one digest for the fields that a
    rule's key determines, however many and wide they are. Columns of ``keep`` are passed on."""
    read = [*_key_columns(rules), *(c for rule in rules for c in rule.rising or ()), *keep]
    contents = [_digest(df, rule.fields).alias(f"_content_{i}") for i, rule in enumerate(rules) if rule.fields]
    return df.select(*[_plain(df, c).alias(c) for c in dict.fromkeys(read)], *contents)


def key_violations(df: DataFrame, rules: Sequence[KeyRule]) -> DataFrame:
    """Keys that break any of the rules, found in one scan and one shuffle."""
    return broken_keys(key_facts(df, rules), rules)


def broken_keys(facts: DataFrame, rules: Sequence[KeyRule]) -> DataFrame:
    """``key_violations`` of a table's ``key_facts``.

    A row becomes one narrow row per rule: number of the rule, key columns (null where they are not of
    its key), digest of the determined fields. Smallest against largest digest needs no distinct, and a
    hash aggregate keeps numbers only, so repeated keys shrink in the tasks before anything is shuffled,
    whatever the number of rules. Keys meet as they are; only those reported become text.
    """
    columns = _key_columns(rules)
    kinds = dict(facts.dtypes)
    nothing = F.lit(None)
    parts = []
    for i, rule in enumerate(rules):
        threshold, label = map(F.col, rule.rising) if rule.rising else (nothing, nothing)
        parts.append(
            F.struct(
                F.lit(i).alias("rule"),
                *[(F.col(k) if k in rule.keys else nothing.cast(kinds[k])).alias(f"_key_{j}") for j, k in enumerate(columns)],
                (F.col(f"_content_{i}") if rule.fields else nothing.cast("bigint")).alias("content"),
                F.when(label == 0.0, threshold).cast("double").alias("no"),
                F.when(label == 1.0, threshold).cast("double").alias("yes"),
            )
        )
    found = (
        facts.select(F.inline(F.array(*parts)))
        .groupBy("rule", *[f"_key_{j}" for j in range(len(columns))])
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.min("content") != F.max("content")).alias("differs"),
            (F.min("no") <= F.max("yes")).alias("rises"),
        )
    )
    numbers = [i for i, r in enumerate(rules) if r.once]
    repeated = F.col("rule").isin(numbers) & (F.col("n") > 1)
    fired = F.coalesce("differs", F.lit(False)) | F.coalesce("rises", F.lit(False)) | repeated
    names = F.array(*[F.lit(r.rule) for r in rules])
    texts = [
        F.concat_ws("|", *[F.col(f"_key_{columns.index(k)}").cast("string") for k in rule.keys]) for rule in rules
    ]
    key = F.coalesce(*[F.when(F.col("rule") == i, text) for i, text in enumerate(texts)])
    return found.where(fired).select(
        F.element_at(names, F.col("rule") + 1).alias("rule_id"), key.alias("key"),
        F.when(repeated, F.col("n").cast("string")).otherwise("").alias("detail"),
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return key_violations(df, [KeyRule(rule, tuple(keys), once=True)])


def dependency(df: DataFrame, keys: Sequence[str], fields: Sequence[str], rule: str) -> DataFrame:
    """Keys that do not determine ``fields``."""
    return key_violations(df, [KeyRule(rule, tuple(keys), tuple(fields))])


EVENT_FIELDS = ("asset", "split", "utc_day", "scheduled_time", "source_event_sha256")
MARKET_FIELDS = ("condition_id", "threshold", "label", "yes_token", "source_history_sha256")
CONDITION_FIELDS = (
    "label",
    "payout_vector",
    "resolution_block_number",
    "resolution_block_hash",
    "resolution_block_timestamp",
    "resolution_tx_hash",
    "resolution_log_index",
    "chain_source_sha256",
)


def rising_label_edges(df: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Neighbouring thresholds whose label rises."""
    parts = segment(
        df.select("event_id", "horizon_seconds", "threshold", "label"),
        ["event_id", "horizon_seconds"],
        "threshold",
        max_rows,
    )
    return with_next(parts, "label", "next_label").where("label < next_label")


def ladders_differ(df: DataFrame) -> DataFrame:
    """Events whose (market, threshold, label) set is not the same at every horizon.

    Rungs move once, with the few horizons they occur at; events with their distinct sets of these.
    """
    at = F.array_sort(F.collect_set(F.struct("horizon_seconds"))).alias("at")
    rungs = df.where("event_id is not null").groupBy("event_id", "market_id", "threshold", "label").agg(at)
    sets = rungs.groupBy("event_id").agg(F.min(F.size("at")).alias("fewest"), F.collect_set("at").alias("sets"))
    bad = sets.where(F.col("fewest") != F.size(F.array_distinct(F.flatten("sets"))))
    return _violations(bad, "ladder_differs_across_horizons", key_text("event_id"))


CURVE_KEY = ("event_id", "horizon_seconds")
KEY_RULES = (
    KeyRule("duplicate_row", ROW_KEY, once=True),
    KeyRule("event_properties_disagree", ("event_id",), EVENT_FIELDS),
    KeyRule("market_in_several_events", ("market_id",), ("event_id",)),
    KeyRule("market_properties_disagree", ("event_id", "market_id"), MARKET_FIELDS),
    KeyRule("duplicate_threshold", (*CURVE_KEY, "threshold"), once=True),
    KeyRule("labels_rise_along_ladder", CURVE_KEY, rising=("threshold", "label")),
)
CHAIN_RULE = KeyRule("chain_evidence_disagrees", ("condition_id",), CONDITION_FIELDS)


def table_invariants(df: DataFrame, chain: bool = False) -> DataFrame:
    """Keys, functional dependencies and ladder rules of a whole snapshot or evidence table.

    What the rules read is written once to the shared folder, determined fields as digests: the key
    rules scan it once, the comparison of ladders reads five of its columns.
    """
    rules = (*KEY_RULES, CHAIN_RULE) if chain else KEY_RULES
    facts = written(key_facts(df, rules, ROW_KEY), "invariants")
    return broken_keys(facts, rules).unionByName(ladders_differ(facts))


def protocol_violations(df: DataFrame, protocol: Protocol, chain: bool = False) -> DataFrame:
    """Timing rules per row, then ladder sizes per curve, both from one written typed table."""
    wanted = {
        *ROW_KEY, "split", "asset", "utc_day", "scheduled_time", "cutoff_time", "reference_timestamp",
        "staleness_seconds", "event_horizon_contract_count", *(["resolution_block_timestamp"] if chain else []),
    }
    df = written(df.select(*[c for c in df.columns if c in wanted]), "timing")
    splits = protocol.splits
    when = F.col("scheduled_time")
    inside = F.lit(False)
    for name, (start, end) in splits.items():
        lower, upper = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
        inside = inside | ((F.col("split") == name) & (when >= lower) & (when < upper))
    age = F.unix_micros("cutoff_time") - F.unix_micros("reference_timestamp")
    limit = protocol.max_staleness_seconds * MICROS
    rules = {
        "undeclared_split": ~F.col("split").isin(*splits),
        "undeclared_asset": ~F.col("asset").isin(*protocol.assets),
        "undeclared_horizon": ~F.col("horizon_seconds").isin(*protocol.horizons),
        "scheduled_outside_split": ~inside,
        "utc_day_differs": F.col("utc_day") != utc_day("scheduled_time"),
        "cutoff_differs": F.unix_micros("cutoff_time")
        != F.unix_micros("scheduled_time") - F.col("horizon_seconds") * MICROS,
        "future_reference_point": age < 0,
        "staleness_differs": F.col("staleness_seconds") != F.floor(age / MICROS),
        "staleness_above_limit": age > limit,
        "ladder_below_minimum": F.col("event_horizon_contract_count")
        < protocol.minimum_thresholds,
    }
    if chain:
        grace = protocol.resolution_grace_seconds * MICROS
        delay = F.unix_micros("resolution_block_timestamp") - F.unix_micros("scheduled_time")
        rules["resolution_outside_grace"] = (delay < 0) | (delay > grace)
    per_row = row_rules(df, rules, key_text(*ROW_KEY))
    curves = df.groupBy("event_id", "horizon_seconds").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_horizon_contract_count").alias("least"),
        F.max("event_horizon_contract_count").alias("most"),
    )
    wrong = curves.where("least <> n or most <> n")
    return per_row.unionByName(
        _violations(wrong, "contract_count_differs", key_text("event_id", "horizon_seconds"))
    )


def late_features(df: DataFrame, feature: str, cutoff: str, embargo_seconds: int, key: Column) -> DataFrame:
    """Features observed after the embargoed cutoff; equality passes."""
    if embargo_seconds < 0:
        raise ValueError("an embargo cannot be negative")
    allowed = F.unix_micros(cutoff) - embargo_seconds * MICROS
    return _violations(
        df.where(F.unix_micros(feature) > allowed), "feature_after_cutoff", key
    )


def late_labels(df: DataFrame, resolved: str, cutoff: str, embargo_seconds: int, key: Column) -> DataFrame:
    """Labels not strictly resolved before the embargoed cutoff."""
    if embargo_seconds < 0:
        raise ValueError("an embargo cannot be negative")
    allowed = F.unix_micros(cutoff) - embargo_seconds * MICROS
    return _violations(df.where(F.unix_micros(resolved) >= allowed), "label_not_before_cutoff", key)


def shared_split_events(df: DataFrame) -> DataFrame:
    """Events that occur in more than one split."""
    bad = df.groupBy("event_id").agg((F.min("split") != F.max("split")).alias("bad")).where("bad")
    return _violations(bad, "event_in_several_splits", key_text("event_id"))


def forbidden_columns(
    catalogue: DataFrame, forbidden: Sequence[str] = FORBIDDEN_FEATURES
) -> DataFrame:
    """Rows of a ``(table_name, column_name)`` catalogue that name a post-outcome field."""
    spark = catalogue.sparkSession
    listed = spark.createDataFrame([(n,) for n in forbidden], "name string")
    names = listed.select(snake_name("name").alias("normal")).distinct()
    found = catalogue.withColumn("normal", snake_name("column_name"))
    return found.join(F.broadcast(names), "normal", "left_semi").select(
        "table_name", "column_name"
    )


def assert_safe_features(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN_FEATURES) -> None:
    """Reject a feature table whose columns reveal the outcome."""
    rows = [("features", name) for name in df.columns]
    catalogue = df.sparkSession.createDataFrame(rows, "table_name string, column_name string")
    bad = sorted(row["column_name"] for row in forbidden_columns(catalogue, forbidden).collect())
    if bad:
        raise DataQualityError(f"columns that reveal the outcome: {bad}")


def absent(df: DataFrame, known: DataFrame, on: Sequence[str], rule: str, key: Column) -> DataFrame:
    """Rows whose ``on`` values are not in ``known`` (anti join on its distinct values)."""
    present = known.select(*on).distinct()
    return _violations(df.join(present, list(on), "left_anti"), rule, key)


def binding_mismatches(bindings: DataFrame, digests: DataFrame) -> DataFrame:
    """Bindings ``(document, path, expected)`` that differ from the digests found for ``path``."""
    joined = bindings.join(digests.select("path", F.col("sha256").alias("found")), "path", "left")
    bad = joined.where(~F.col("expected").eqNullSafe(F.col("found")))
    return _violations(bad, "binding_differs", key_text("document", "path"))


def sequence_gaps(df: DataFrame, sequence: str, request: str) -> DataFrame:
    """Breaks of the numbering 1..n, found without ordering the whole table.

    Numbers must be unique, and every number but 1 must have a predecessor.
    """
    numbers = df.groupBy(F.col(sequence).alias("n")).agg(
        F.count(F.lit(1)).alias("copies"),
        F.max((F.col(request) != F.col(sequence)).cast("int")).alias("differs"),
    )
    after = numbers.select((F.col("n") + 1).alias("n"), F.lit(True).alias("has_previous"))
    checked = numbers.join(after, "n", "left")
    problem = (
        F.when(F.col("copies") > 1, "sequence_repeated")
        .when(F.col("has_previous").isNull() & (F.col("n") != 1), "sequence_gap")
        .when(F.col("differs") == 1, "request_id_differs")
    )
    bad = checked.withColumn("problem", problem).where("problem is not null")
    return bad.select(
        F.col("problem").alias("rule_id"), F.col("n").cast("string").alias("key"), F.lit("").alias("detail")
    )
