"""Ordered operations inside groups, safe when one group holds a large share of all rows.

A window partitioned by a hot key would sort that whole key in one task. Groups above
``max_rows`` are therefore cut into ordered segments by a range repartition; everything else keeps
segment 0 and costs one hash exchange. What crosses a segment border is carried by a table with
one row per segment, which is bounded by the number of range partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.session import checkpointed

MAX_GROUP_ROWS = 250_000
BROADCAST_ROWS = 500_000
SEGMENT = "_segment"


@dataclass(frozen=True)
class Segmented:
    """Rows with a ``_segment`` column; ``hot`` tells whether any group has more than one."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    hot: bool

    @property
    def window(self):
        return Window.partitionBy(*self.keys, SEGMENT).orderBy(self.order)

    def borders(self, *aggregates: Column) -> DataFrame:
        """One row per (group, segment) of the split groups only."""
        return self.df.where(F.col(SEGMENT) > 0).groupBy(*self.keys, SEGMENT).agg(*aggregates)


def same(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal; the keys of ``left`` stay, those of ``right`` go."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    test = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, test, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only when the proven row count is within the limit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def segment(
    df: DataFrame, keys: list[str], order: str, max_rows: int = MAX_GROUP_ROWS
) -> Segmented:
    """Cut oversized groups into ordered segments numbered upwards from 1."""
    sizes = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    )
    hot_groups, hot_rows = sizes.agg(F.count("_n"), F.sum("_n")).first()
    if not hot_groups:
        return Segmented(df.withColumn(SEGMENT, F.lit(0)), tuple(keys), order, False)
    hot_keys = small(sizes.select(*keys), hot_groups)
    cold = same(df, hot_keys, keys, "left_anti").withColumn(SEGMENT, F.lit(0))
    pieces = 2 * math.ceil(hot_rows / max_rows)
    hot = checkpointed(
        same(df, hot_keys, keys, "left_semi")
        .repartitionByRange(pieces, *keys, order)
        .withColumn(SEGMENT, F.spark_partition_id() + 1)
    )
    return Segmented(cold.unionByName(hot), tuple(keys), order, True)


def _across_borders(parts: Segmented, borders: DataFrame, carried: Column, name: str) -> DataFrame:
    along = Window.partitionBy(*parts.keys).orderBy(SEGMENT)
    table = borders.select(*parts.keys, SEGMENT, carried.over(along).alias(name))
    return same(parts.df, F.broadcast(table), [*parts.keys, SEGMENT], "left")


def with_next(parts: Segmented, value: str, name: str) -> DataFrame:
    """Add the value of the following row of the group (null on the last row).

    Only the last row of a segment takes the head of the next one, so null values stay null.
    """
    if not parts.hot:
        return parts.df.withColumn(name, F.lead(value).over(parts.window)).drop(SEGMENT)
    first = F.struct(F.col(parts.order).alias("o"), F.col(value).alias("v"))
    heads = parts.borders(F.min(first)["v"].alias("_head"))
    joined = _across_borders(parts, heads, F.lead("_head"), "_carried")
    is_last = F.lead(F.lit(1)).over(parts.window).isNull()
    following = F.when(is_last, F.col("_carried")).otherwise(F.lead(value).over(parts.window))
    return joined.withColumn(name, following).drop(SEGMENT, "_carried")


def _before(parts: Segmented, inside: Column, amount: Column, name: str) -> DataFrame:
    """Add ``inside`` plus the ``amount`` found in all earlier segments of the group."""
    if not parts.hot:
        return parts.df.withColumn(name, inside).drop(SEGMENT)
    totals = parts.borders(F.sum(amount).alias("_own"))
    along = Window.partitionBy(*parts.keys).orderBy(SEGMENT)
    table = totals.select(
        *parts.keys, SEGMENT, (F.sum("_own").over(along) - F.col("_own")).alias("_earlier")
    )
    joined = same(parts.df, F.broadcast(table), [*parts.keys, SEGMENT], "left")
    carried = F.coalesce(F.col("_earlier"), F.lit(0).cast("bigint"))
    return joined.withColumn(name, inside + carried).drop(SEGMENT, "_earlier")


def with_index(parts: Segmented, name: str) -> DataFrame:
    """Add the zero-based position of each row inside its group."""
    local = (F.row_number().over(parts.window) - 1).cast("bigint")
    return _before(parts, local, F.lit(1).cast("bigint"), name)


def with_total_before(parts: Segmented, weight: str, name: str) -> DataFrame:
    """Add the sum of an integer ``weight`` over all earlier rows of the group."""
    so_far = parts.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.sum(weight).over(so_far) - F.col(weight)
    return _before(parts, local, F.col(weight), name)


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    fractions: dict[str, float],
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact percentiles per group, linearly interpolated, without holding a group in one task.

    Equal values are counted first, so a value shared by many rows is one row from there on. Null
    values do not count; a group of nulls only has null percentiles; null keys are a group. Without
    keys the totals are one row, which is broadcast.
    """
    by, keys = keys, keys or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    present = counted.where(F.col(value).isNotNull())
    placed = with_total_before(segment(present, keys, value, max_rows), "_n", "_start")
    counts = F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))).alias("_total")
    totals = counted.groupBy(*keys).agg(counts)
    ranked = same(placed, totals if by else F.broadcast(totals), keys)
    marks = []
    for name, q in fractions.items():
        at = F.lit(q) * (F.col("_total") - 1)
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_start") <= position) & (position < F.col("_start") + F.col("_n"))
            marks.append(F.max(F.when(here, F.col(value))).alias(f"{name}_{side}"))
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_found"), *marks)
    out = []
    for name, q in fractions.items():
        at = F.lit(q) * (F.col("_found") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    if not by:
        return found.select(*out)
    return same(totals, found, keys, "left").select(*by, *out)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.first(c, ignorenulls=True).alias(c) for c in merged.columns])
