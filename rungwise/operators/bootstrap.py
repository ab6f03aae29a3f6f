"""Paired hierarchical bootstrap: time blocks first, then events inside each drawn block.

Draws come from counter-based generators, so every task computes its own draws from (seed,
replicate, slot, draw) and a lost executor recomputes exactly the same ones.

Blocks of up to ``BLOCK_EVENTS`` events are one bounded array each, and a NumPy kernel adds up the
draws of a range of replicates: what leaves a task is one sum per replicate, not a row per draw.

A larger block is cut into chunks of events, and its draws are split among them instead of made one
by one (conditional binomial splitting): a replicate that picks the block m times draws m times its
size; down a binary tree over the chunks, the draws that go left are binomial given those of the
node; in a chunk its events are drawn evenly. Each node has its own Philox stream, keyed
by seed, block, node and range of replicates, so all chunks agree on the split without exchanging
anything; neighbouring small chunks are worked together. No draw is a row. The two ways are equal in
distribution, and which blocks a replicate picks is the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.functions.numeric import is_finite
from rungwise.operators.ordered import (
    MAX_GROUP_ROWS,
    segment,
    side_by_side,
    small,
    with_index,
)
from rungwise.session import written

# Fixed values of the generator: a prime modulus, counter multipliers and round salts.
PRIME = 2147483647
SEED_STEP, REPLICATE_STEP, SLOT_STEP, DRAW_STEP = 1000003, 7919, 104729, 15485863
BLOCK_SALTS = (374761393, 668265263)
EVENT_SALTS = (1274126177, 97531)
BLOCK_EVENTS = 50_000
CHUNK_EVENTS = 4096
#: Marks the streams of chunks among those of tree nodes.
LEAF = 1
REPLICATES_PER_TASK = 1_250
POOLS_PER_CORE = 8
KERNEL_CELLS = 1 << 20
#: Draws counted at once; the counts fit a core's cache.
DRAWN_CELLS = 1 << 16


def drawn(seed: int, replicate, slot, draw, salts: tuple[int, int]) -> np.ndarray:
    """Reproducible integers in ``[0, PRIME)``; a bound is applied by its remainder.

    Three rounds of ``x**5`` modulo PRIME (a permutation, as 5 does not divide PRIME - 1) with a
    salt between them; every product fits 64 bits.
    """
    x = (seed * SEED_STEP + replicate * REPLICATE_STEP + slot * SLOT_STEP + (draw + 1) * DRAW_STEP) % PRIME
    for salt in (*salts, 0):
        square = x * x % PRIME
        x = (x * (square * square % PRIME) % PRIME + salt) % PRIME
    return x


def picks(index: int, blocks: int, seed: int, first: int, last: int) -> np.ndarray:
    """(replicate, slot) pairs of replicates first..last-1 that draw block ``index``."""
    found = []
    slots_at_once = max(1, KERNEL_CELLS // (last - first))
    for low in range(0, blocks, slots_at_once):
        slot = np.arange(low, min(blocks, low + slots_at_once), dtype=np.int64)
        replicate = np.arange(first, last, dtype=np.int64)
        hit = drawn(seed, replicate[:, None], slot[None, :], 0, BLOCK_SALTS) % blocks == index
        found.append(np.argwhere(hit) + [first, low])
    return np.concatenate(found).astype(np.int64)


def block_sums(
    values: np.ndarray, index: int, blocks: int, seed: int, first: int, last: int
) -> tuple[np.ndarray, np.ndarray]:
    """Replicates first..last-1 that draw block ``index`` at all, and the sums of their draws."""
    n = len(values)
    pairs = picks(index, blocks, seed, first, last)
    sums = np.zeros((last - first, values.shape[1]))
    counts = np.zeros(last - first, np.int64)
    step = max(1, KERNEL_CELLS // n)
    draw = np.arange(n, dtype=np.int64)
    for at in range(0, len(pairs), step):
        part = pairs[at : at + step]
        picked = drawn(seed, part[:, :1], part[:, 1:], draw[None, :], EVENT_SALTS) % n
        weight = np.zeros((last - first, n)) if (last - first) * n <= 8 * KERNEL_CELLS else None
        if weight is None:
            np.add.at(sums, part[:, 0] - first, values[picked].sum(1))
        else:
            # How often each event is drawn in each replicate, then one matrix product.
            flat = ((part[:, :1] - first) * n + picked).ravel()
            weight = np.bincount(flat, minlength=weight.size).reshape(weight.shape)
            sums += weight @ values
        np.add.at(counts, part[:, 0] - first, n)
    some = np.flatnonzero(counts)
    return some + first, np.column_stack([counts[some], sums[some]])


def _stream(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def _drawn_sums(values: np.ndarray, draws: np.ndarray, own: np.random.Generator) -> np.ndarray:
    """Sums of ``draws`` (above zero, one number per replicate) uniform draws from ``values``.

    A replicate draws each event once on average, so single draws are cheaper than a binomial per
    event and replicate; how often each was drawn is counted, then multiplied with the values.
    """
    n = len(values)
    sums = np.zeros((len(draws), values.shape[1]))
    ends = np.cumsum(draws)
    at = 0
    while at < len(draws):
        drawn_before = ends[at] - draws[at]
        fits = int(np.searchsorted(ends, drawn_before + DRAWN_CELLS, "right"))
        to = max(at + 1, min(fits, at + max(1, DRAWN_CELLS // n)))
        of = np.repeat(np.arange(to - at, dtype=np.int64) * n, draws[at:to])
        of += own.integers(0, n, size=len(of), dtype=np.int32)
        weight = np.bincount(of, minlength=(to - at) * n).reshape(to - at, n)
        sums[at:to] = weight @ values
        at = to
    return sums


def _leaf_draws(
    chunk: int, end: int, n: int, chunk_events: int, index: int, blocks: int, seed: int, first: int, last: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, draws that replicates first..last-1 make in it) for chunks ``chunk``..``end`` - 1 of
    block ``index`` of n events; chunks without any draw are left out."""
    times = np.bincount(picks(index, blocks, seed, first, last)[:, 0] - first, minlength=last - first)
    nodes = [(0, -(-n // chunk_events), times * n)]
    while nodes:
        low, high, draws = nodes.pop()
        if high <= chunk or low >= end or not draws.any():
            continue
        if high - low == 1:
            yield low, draws
            continue
        middle = (low + high) // 2
        events = min(high * chunk_events, n) - low * chunk_events
        left = (middle - low) * chunk_events
        goes_left = _stream(seed, index, low, high, first).binomial(draws, left / events)
        nodes += [(low, middle, goes_left), (middle, high, draws - goes_left)]


def chunk_draws(
    chunk: int, n: int, chunk_events: int, index: int, blocks: int, seed: int, first: int, last: int
) -> np.ndarray:
    """How many draws of replicates first..last-1 fall into a chunk of block ``index`` of n events."""
    found = _leaf_draws(chunk, chunk + 1, n, chunk_events, index, blocks, seed, first, last)
    return next((draws for _, draws in found), np.zeros(last - first, np.int64))


def chunk_sums(
    values: np.ndarray, chunk: int, n: int, chunk_events: int, index: int, blocks: int, seed: int, first: int, last: int
) -> tuple[np.ndarray, np.ndarray]:
    """As ``block_sums``, for the neighbouring chunks from ``chunk`` on that ``values`` holds, of a
    block of ``n`` events. The tree is walked once for all of them."""
    end = chunk - (-len(values) // chunk_events)
    counts = np.zeros(last - first, np.int64)
    sums = np.zeros((last - first, values.shape[1]))
    for leaf, draws in _leaf_draws(chunk, end, n, chunk_events, index, blocks, seed, first, last):
        own, some = _stream(seed, index, leaf, first, LEAF, LEAF), np.flatnonzero(draws)
        here = values[(leaf - chunk) * chunk_events : (leaf - chunk + 1) * chunk_events]
        sums[some] += _drawn_sums(here, draws[some], own)
        counts += draws
    some = np.flatnonzero(counts)
    return some + first, np.column_stack([counts[some], sums[some]])


def _number(x: Column) -> Column:
    return x.cast("double")


def _kernel(strata: list[str], diffs: list[str], seeds: list[int], names: list[str], chunk_events: int, chunks: int):
    def run(batches):
        for batch in batches:
            bounds = ("block_index", "blocks", "first", "last", "span", "block_events")
            rows = [batch.column(c).to_pylist() for c in (*strata, *bounds)]
            for k in range(batch.num_rows):
                values = np.column_stack([batch.column(f"v{i}")[k].values.to_numpy(zero_copy_only=False) for i in range(len(diffs))])
                index, blocks, first, last, span, n = (r[k] for r in rows[len(strata) :])
                for seed in seeds:
                    if span is None:
                        which, table = block_sums(values, index, blocks, seed, first, last)
                    else:
                        which, table = chunk_sums(values, span * chunks, n, chunk_events, index, blocks, seed, first, last)
                    keys = [pa.array([rows[i][k]] * len(which), batch.column(c).type) for i, c in enumerate(strata)]
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array([seed] * len(which), pa.int64()), pa.array(which, pa.int64()),
                         pa.array(table[:, 0].astype(np.int64)), *(pa.array(table[:, 1 + i]) for i in range(len(diffs)))],
                        names=names,
                    )

    return run


def check_inputs(events: DataFrame, losses: Sequence[str]) -> None:
    """Guards of the bootstrap: one block per event, finite non-negative losses, two blocks."""
    bad = [~is_finite(loss) | (F.col(loss) < 0) for loss in losses]
    facts = (
        events.groupBy("event_id")
        .agg(
            (F.min("block") != F.max("block")).alias("split_block"),
            F.max(F.greatest(*[b.cast("int") for b in bad], F.lit(0))).alias("bad"),
            F.min("block").alias("block"),
        )
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.max("split_block").alias("split_block"),
            F.max("bad").alias("bad"),
            (F.min("block") != F.max("block")).alias("two_blocks"),
        )
        .first()
    )
    if not facts["events"]:
        raise ValueError("the bootstrap got no events")
    if facts["split_block"]:
        raise ValueError("events may not be spread over several blocks")
    if facts["bad"]:
        raise ValueError("a loss is negative, missing or not finite")
    if not facts["two_blocks"]:
        raise ValueError("resampling blocks takes two of them or more")


def check_settings(resamples: int, confidence: float, seed: int) -> None:
    if isinstance(resamples, bool) or not isinstance(resamples, int) or resamples <= 0:
        raise ValueError("the number of resamples is a whole number above zero")
    if not 0.0 < confidence < 1.0:
        raise ValueError("the confidence is strictly between zero and one")
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise ValueError("the seed is a whole number, zero or more")


def replicates(
    events: DataFrame,
    diffs: Sequence[str],
    resamples: int,
    seeds: Sequence[int],
    strata: Sequence[str] = (),
    max_rows: int = MAX_GROUP_ROWS,
    block_events: int = BLOCK_EVENTS,
    chunk_events: int = CHUNK_EVENTS,
) -> DataFrame:
    """One row per (stratum, seed, replicate) with the mean of every ``diffs`` column.

    ``events`` holds one row per event: ``event_id, block``, the strata and the paired differences
    (not null). Strata are resampled independently; all difference columns share the draws. Draws of
    blocks above ``block_events`` are split among chunks of ``chunk_events``, see the module's text.
    """
    strata = list(strata)
    columns = [*strata, "event_id", "block", *diffs]
    if not strata:
        strata, events = ["_all"], events.withColumn("_all", F.lit(0))
        columns.append("_all")
    # One narrow row per event feeds several jobs: written once, read from there.
    paired = written(events.select(*columns), "paired")
    placed = with_index(
        segment(paired, [*strata, "block"], "event_id", max_rows), "event_index"
    )
    sizes = placed.groupBy(*strata, "block").agg(F.count(F.lit(1)).alias("block_events"))
    blocks = with_index(segment(sizes, strata, "block", max_rows), "block_index")
    totals = sizes.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("block_events").alias("stratum_events")
    )
    fewest, n_blocks, n_events = totals.agg(
        F.min("blocks"), F.sum("blocks"), F.sum("stratum_events")
    ).first()
    if fewest is None or fewest < 2:
        raise ValueError("resampling blocks takes two of them or more")

    placed = placed.join(small(blocks.select(*strata, "block", "block_index", "block_events"), n_blocks), [*strata, "block"])
    names = [*strata, "seed", "replicate", "_n", *[f"_s{i}" for i in range(len(diffs))]]
    ordered = F.sort_array(F.collect_list(F.struct("event_index", *diffs)))
    # Neighbouring small chunks share a task's array, one walk down the tree and one row per replicate.
    chunks = max(1, CHUNK_EVENTS // chunk_events)
    span = F.when(F.col("block_events") > block_events, F.floor(F.col("event_index") / (chunks * chunk_events)))
    pools = (
        placed.withColumn("span", span)
        .groupBy(*strata, "block_index", "block_events", "span")
        .agg(ordered.alias("_pool"))
        .join(F.broadcast(totals.select(*strata, "blocks")), strata)
    )
    n_pools = int(n_blocks) + int(n_events) // max(chunk_events, CHUNK_EVENTS)
    # Enough pools to go round move once each; of a few, every range of replicates is a task of its own.
    once = n_pools >= POOLS_PER_CORE * events.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n_pools if once else n_pools * -(-resamples // REPLICATES_PER_TASK), 10_000))
    firsts = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(REPLICATES_PER_TASK)))
    moved = pools.repartition(tasks).withColumn("first", firsts) if once else pools.withColumn("first", firsts).repartition(tasks)
    ranges = moved.withColumn("last", F.least(F.col("first") + REPLICATES_PER_TASK, F.lit(resamples))).select(
        *strata, "block_index", "blocks", "first", "last", "span", "block_events",
        *[F.transform(F.col(f"_pool.{d}"), _number).alias(f"v{i}") for i, d in enumerate(diffs)],
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paired.schema if f.name in strata)
    kinds += ", seed bigint, replicate bigint, _n bigint, " + ", ".join(f"_s{i} double" for i in range(len(diffs)))
    kernel = _kernel(strata, list(diffs), [int(s) for s in seeds], names, chunk_events, chunks)
    sums = ranges.mapInArrow(kernel, kinds)
    totalled = sums.groupBy(*strata, "seed", "replicate").agg(
        F.sum("_n").alias("_n"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(diffs))]
    )
    means = [(F.col(f"_s{i}") / F.col("_n")).alias(d) for i, d in enumerate(diffs)]
    return totalled.select(*strata, "seed", "replicate", *means).drop("_all")


def intervals(
    replicate_table: DataFrame, diffs: Sequence[str], confidence: float, by: Sequence[str] = ()
) -> DataFrame:
    """Percentile interval (linear interpolation) of every difference column, one row each.

    A group holds one number per replicate and column.
    """
    tail = (1.0 - confidence) / 2.0
    bounds = replicate_table.groupBy(*by).agg(
        *[F.percentile(d, F.array(F.lit(tail), F.lit(1.0 - tail))).alias(d) for d in diffs]
    )
    rows = [
        F.struct(
            F.lit(d).alias("name"), F.col(d)[0].alias("lower"), F.col(d)[1].alias("upper")
        )
        for d in diffs
    ]
    return bounds.select(*by, F.inline(F.array(*rows)))


def paired_bootstrap(
    events: DataFrame,
    baseline: str,
    model: str,
    resamples: int = 10_000,
    confidence: float = 0.95,
    seed: int = 0,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Estimate and interval of ``mean(baseline - model)`` over events.

    ``events`` may hold row losses; they are averaged within event first.
    """
    check_settings(resamples, confidence, seed)
    check_inputs(events, [baseline, model])
    paired = events.groupBy("event_id").agg(
        F.min("block").alias("block"), (F.avg(baseline) - F.avg(model)).alias("diff")
    )
    bounds = intervals(replicates(paired, ["diff"], resamples, [seed], max_rows=max_rows), ["diff"], confidence)
    estimate = paired.agg(F.avg("diff").alias("estimate"))
    return side_by_side(estimate, bounds.drop("name"))
