"""Thresholds and templates in free text, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted number and unit patterns and what each unit multiplies by.
NUMBER = r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?"
UNIT = r"(thousand|million|billion|trillion|percentage|percent|bps?|k|m|b|t|%)"
MULTIPLIERS = {
    "k": 1e3,
    "thousand": 1e3,
    "m": 1e6,
    "million": 1e6,
    "b": 1e9,
    "billion": 1e9,
    "t": 1e12,
    "trillion": 1e12,
    "%": 0.01,
    "percent": 0.01,
    "percentage": 0.01,
    "bp": 0.0001,
    "bps": 0.0001,
}

# Column names that reveal the outcome or the state after it.
FORBIDDEN_FEATURES = (
    "best_ask",
    "best_bid",
    "closed_time",
    "current_description",
    "current_tags",
    "description",
    "final_liquidity",
    "final_volume",
    "label",
    "last_trade_price",
    "liquidity",
    "liquidity_num",
    "outcome_prices",
    "resolved_outcome",
    "tags",
    "target",
    "uma_end_date",
    "volume",
    "volume_num",
    "winner",
)

TEMPLATE_GAP = "___"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def threshold(text: Column | str) -> Column:
    """The one number in ``text``, scaled by its unit; null when there is not exactly one."""
    text = _col(text)
    found = F.regexp_extract_all(text, F.lit(f"(?U)({NUMBER})"), F.lit(1))
    digits = F.try_element_at(found, F.lit(1))
    unit = F.lower(
        F.regexp_extract(text, rf"(?U)(?>{NUMBER})\s*(?i:{UNIT})(?=\s|\+|$)", 1)
    )
    factors = F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair])
    scale = F.coalesce(F.try_element_at(factors, unit), F.lit(1.0))
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * scale
    return F.when((F.size(found) == 1) & (F.abs(value) < float("inf")), value)


def fill_template(template: Column | str, part: Column | str) -> Column:
    """Replace the first gap of the template, literally; a template without gap is unchanged."""
    template, part = _col(template), _col(part)
    at = F.instr(template, TEMPLATE_GAP)
    head = F.substring(template, F.lit(1), at - 1)
    tail = F.substring(template, at + len(TEMPLATE_GAP), F.length(template))
    return F.when(at > 0, F.concat(head, part, tail)).otherwise(
        F.when(part.isNotNull(), template)
    )


def asset_of_title(title: Column | str, assets: Iterable[str]) -> Column:
    """First declared asset for which the title starts with ``"<asset> above "``."""
    title, picked = _col(title), None
    for asset in assets:
        test = F.startswith(title, F.lit(f"{asset} above "))
        picked = F.when(test, asset) if picked is None else picked.when(test, asset)
    return picked


def snake_name(name: Column | str) -> Column:
    """camelCase and dashes to snake_case, underscores collapsed and trimmed, lower case."""
    split = F.regexp_replace(_col(name), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    joined = F.regexp_replace(F.replace(split, F.lit("-"), F.lit("_")), "_+", "_")
    return F.trim(F.lower(joined), F.lit("_"))


def decimal_text(value: Column | str) -> Column:
    """Whether a text is a plain decimal number (ids exceed 64 bits, so they stay text)."""
    return F.coalesce(_col(value).rlike(r"^[0-9]+\z"), F.lit(False))


def identifier_order(value: Column | str) -> list[Column]:
    """Sort columns: decimal ids first and numerically, without a cast, then text."""
    value = _col(value)
    numeric = decimal_text(value)
    digits = F.ltrim(value, F.lit("0"))
    return [
        F.when(numeric, 0).otherwise(1),
        F.when(numeric, F.length(digits)).otherwise(0),
        F.when(numeric, digits).otherwise(value),
    ]
