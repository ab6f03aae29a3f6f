"""Grouped non-increasing isotonic projection of ladder probabilities.

Ladders are hash-partitioned and sorted by Spark; a NumPy kernel pools adjacent violators for
whole Arrow batches at a time. A ladder longer than the group limit is cut into ordered segments
that are projected on their own. The exact joint solution is then the local one clamped, per
segment, to the value of any block that crosses the segment's lower or upper border, so only
border blocks have to be merged across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.operators.ordered import MAX_GROUP_ROWS, SEGMENT, segment
from rungwise.session import checkpointed

_ROUNDS_BEFORE_STACK = 64


def pool_nonincreasing(values: np.ndarray, weights: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Project each run of equal ``group`` onto non-increasing sequences.

    Every maximal run of rising neighbours ends up in one block of the solution, so all such runs
    are pooled together, for all groups, until none is left. A block of one keeps its exact value.
    """
    mean, total, weight = values.copy(), values * weights, weights.copy()
    owner, size = group, np.ones(len(values), dtype=np.int64)
    rounds = 0
    while len(mean) > 1:
        rising = (owner[1:] == owner[:-1]) & (mean[:-1] < mean[1:])
        if not rising.any():
            break
        if rounds == _ROUNDS_BEFORE_STACK:
            starts = _stack_starts(total, weight, mean, owner)
        else:
            starts = np.flatnonzero(np.concatenate(([True], ~rising)))
        merged = np.diff(np.append(starts, len(mean))) > 1
        first = mean[starts]
        total, weight = np.add.reduceat(total, starts), np.add.reduceat(weight, starts)
        mean = np.where(merged, total / weight, first)
        owner, size = owner[starts], np.add.reduceat(size, starts)
        rounds += 1
    return np.repeat(mean, size)


def _stack_starts(total, weight, mean, owner) -> np.ndarray:
    """Block starts found in one left-to-right pass, for inputs that pool one pair at a time."""
    stack: list[list] = []
    for i in range(len(mean)):
        block = [i, total[i], weight[i], mean[i]]
        while stack and owner[stack[-1][0]] == owner[i] and stack[-1][3] < block[3]:
            left = stack.pop()
            joined, mass = left[1] + block[1], left[2] + block[2]
            block = [left[0], joined, mass, joined / mass]
        stack.append(block)
    return np.array([block[0] for block in stack])


def _runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Number the runs of equal keys in a table sorted by them."""
    changed = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for key in keys:
        column = table[key].combine_chunks()
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(changed)))


def _kernel(keys: list[str], outputs: dict[str, str], weight: str | None):
    """Arrow batches sorted by ``keys`` in, the same rows with projected columns out."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = _runs(table, keys)
        weights = np.ones(table.num_rows) if weight is None else table[weight].to_numpy()
        for value, name in outputs.items():
            fitted = pool_nonincreasing(table[value].to_numpy().astype(float), weights, group)
            table = table.append_column(name, pa.array(fitted))
        yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = _runs(pa.Table.from_batches([batch]), keys)
            cut = int(np.searchsorted(runs, runs[-1]))
            if cut or (held and _differs(held[-1], batch, keys)):
                complete = [*held, batch.slice(0, cut)] if cut else held
                yield from solve(pa.Table.from_batches(complete).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _differs(left: pa.RecordBatch, right: pa.RecordBatch, keys: list[str]) -> bool:
    return any(left[key][-1].as_py() != right[key][0].as_py() for key in keys)


def _pool_sorted(
    df: DataFrame,
    keys: list[str],
    order: str,
    outputs: dict[str, str],
    weight: str | None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    moved = df.repartition(*keys)
    moved = derive(moved) if derive else moved
    schema = T.StructType(
        moved.schema.fields + [T.StructField(name, T.DoubleType()) for name in outputs.values()]
    )
    ready = moved.sortWithinPartitions(*keys, order)
    return ready.mapInArrow(_kernel(keys, outputs, weight), schema)


def project_ladders(
    df: DataFrame,
    keys: list[str],
    order: str,
    outputs: dict[str, str],
    weight: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add, for each ``value -> name`` of ``outputs``, the projection along ``order``.

    ``keys`` identify a ladder, ``order`` is its unique threshold. All rows must be valid
    probabilities (see the row rules in ``quality``); labels are never read. ``derive`` adds columns
    that follow from a row alone where its ladder lies, so they are not moved; some may be projected.
    """
    parts = segment(df, keys, order, max_rows)
    local = _pool_sorted(parts.df, [*keys, SEGMENT], order, outputs, weight, derive)
    if not parts.hot:
        return local.drop(SEGMENT)
    split = checkpointed(local.where(F.col(SEGMENT) > 0))
    for value, name in outputs.items():
        bounds = _border_bounds(split, keys, value, name, weight, max_rows)
        raised = F.greatest(F.col(name), F.coalesce("_lo", name))
        split = (
            split.join(F.broadcast(bounds), [*keys, SEGMENT], "left")
            .withColumn(name, F.least(raised, F.coalesce(F.col("_hi"), raised)))
            .drop("_lo", "_hi")
        )
    whole = local.where(F.col(SEGMENT) == 0)
    return whole.unionByName(split).drop(SEGMENT)


def _border_bounds(
    split: DataFrame, keys: list[str], value: str, name: str, weight: str | None, max_rows: int
) -> DataFrame:
    """Per (ladder, segment): value of the solution block crossing each border, if one does."""
    mass = F.col(weight) if weight else F.lit(1.0)
    blocks = checkpointed(
        split.groupBy(*keys, SEGMENT, name)
        .agg(F.sum(mass * F.col(value)).alias("_sum"), F.sum(mass).alias("_mass"))
        .select(
            *keys,
            F.col(SEGMENT).cast("bigint").alias("_chunk"),
            F.col(SEGMENT).alias("_first"),
            F.col(SEGMENT).alias("_last"),
            F.col(name).alias("_mean"),
            "_sum",
            "_mass",
        )
    )
    # Inside a chunk means fall, so (chunk, -mean) is the ladder order of the blocks.
    shift = 0
    while _rises_across_chunks(blocks, keys):
        shift = max_rows // 2 - shift
        regrouped = _rechunk(blocks, keys, max_rows, shift)
        pooled = _pool_sorted(
            regrouped, [*keys, "_chunk"], "_position", {"_mean": "_fit"}, "_mass"
        )
        blocks = checkpointed(
            pooled.groupBy(*keys, "_chunk", F.col("_fit").alias("_mean")).agg(
                F.min("_first").alias("_first"),
                F.max("_last").alias("_last"),
                F.sum("_sum").alias("_sum"),
                F.sum("_mass").alias("_mass"),
            )
        )
    crossing = blocks.where("_first < _last").select(
        *keys, "_first", "_last", "_mean", F.explode(F.sequence("_first", "_last")).alias(SEGMENT)
    )
    return crossing.groupBy(*keys, SEGMENT).agg(
        F.max(F.when(F.col(SEGMENT) < F.col("_last"), F.col("_mean"))).alias("_lo"),
        F.max(F.when(F.col(SEGMENT) > F.col("_first"), F.col("_mean"))).alias("_hi"),
    )


def _rises_across_chunks(blocks: DataFrame, keys: list[str]) -> bool:
    chunks = blocks.groupBy(*keys, "_chunk").agg(
        F.max("_mean").alias("_head"), F.min("_mean").alias("_tail")
    )
    along = Window.partitionBy(*keys).orderBy("_chunk")
    following = chunks.select("_tail", F.lead("_head").over(along).alias("_next"))
    return not following.where("_next > _tail").isEmpty()


def _rechunk(blocks: DataFrame, keys: list[str], max_rows: int, shift: int) -> DataFrame:
    """Move the chunk borders so that what was a border becomes the inside of a chunk."""
    along = Window.partitionBy(*keys).orderBy("_chunk")
    counts = blocks.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_count"))
    offsets = counts.select(
        *keys, "_chunk", (F.sum("_count").over(along) - F.col("_count")).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_mean"))
    return (
        blocks.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), [*keys, "_chunk"])
        .withColumn("_position", F.col("_offset") + F.col("_rank"))
        .withColumn("_chunk", F.floor((F.col("_position") + shift) / max_rows))
        .drop("_rank", "_offset")
    )
