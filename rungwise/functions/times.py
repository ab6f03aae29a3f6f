"""UTC timestamps, half-open windows and block ranges as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted timestamp texts. Spark itself would take a text without a zone.
_CLOCK = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
UTC_TEXT = _CLOCK + r"(Z|[+-]00:?00)$"
ZONED_TEXT = _CLOCK + r"(Z|[+-]\d{2}:?\d{2})$"

DAY_SECONDS = 86_400


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def utc_timestamp(text: Column | str) -> Column:
    """Timestamp from a text whose offset is present and zero; null otherwise."""
    text = _col(text)
    return F.when(text.rlike(UTC_TEXT), F.try_to_timestamp(text))


def zoned_timestamp(text: Column | str) -> Column:
    """Timestamp from a text with any explicit offset, normalised to UTC; null otherwise."""
    text = F.trim(_col(text))
    return F.when(text.rlike(ZONED_TEXT), F.try_to_timestamp(text))


def utc_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_day(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def whole_epoch_seconds(ts: Column | str) -> Column:
    """Epoch seconds; null when the timestamp has a fraction."""
    micros = F.unix_micros(_col(ts))
    return F.when(micros % 1_000_000 == 0, F.floor(micros / 1_000_000))


def daily_windows(start: Column | str, end: Column | str) -> Column:
    """Adjacent windows of at most a day, as ``array<struct<start,end>>``; null if end <= start."""
    start, end = _col(start).cast("timestamp"), _col(end).cast("timestamp")
    day = F.expr("interval 1 day")
    starts = F.filter(F.sequence(start, F.greatest(start, end), day), lambda s: s < end)
    return F.when(
        end > start,
        F.transform(
            starts, lambda s: F.struct(s.alias("start"), F.least(s + day, end).alias("end"))
        ),
    )


def block_ranges(first: Column | str, last: Column | str, span: Column | int) -> Column:
    """Inclusive ranges of at most ``span`` blocks, each sharing one block with the next."""
    first, last = _col(first).cast("bigint"), _col(last).cast("bigint")
    step = (span if isinstance(span, Column) else F.lit(span)).cast("bigint") - 1
    starts = F.sequence(first, F.greatest(first, last), step)
    useful = F.filter(starts, lambda s: (s < last) | ((s == last) & (s == first)))
    return F.when(
        last >= first,
        F.transform(
            useful, lambda s: F.struct(s.alias("first"), F.least(s + step, last).alias("last"))
        ),
    ).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))


def split_of(ts: Column | str, splits: Mapping[str, tuple[str, str]]) -> Column:
    """Name of the declared half-open window holding ``ts``; null outside, error inside two."""
    ts = _col(ts)
    names = F.array_compact(
        F.array(
            *[
                F.when(
                    (ts >= F.to_timestamp(F.lit(start))) & (ts < F.to_timestamp(F.lit(end))),
                    F.lit(name),
                )
                for name, (start, end) in splits.items()
            ]
        )
    )
    return F.when(F.size(names) <= 1, F.try_element_at(names, F.lit(1))).otherwise(
        F.raise_error(F.lit("timestamp belongs to multiple splits"))
    )
