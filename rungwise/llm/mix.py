"""Mixing sources to target weights by a low-discrepancy schedule (operator 8).

Every source's documents are laid end to end in a hashed order and the line, repeated, is cut into
blocks of equally many words. Slot i of the mix gets the source whose interval of the cumulative
weights holds the i-th van der Corput point (base 2), so every stretch of the mix is close to the
weights. The k-th slot of a source takes the k-th block of its line. A source's last block is
cut at its target; slots that the points leave open (a few, as the discrepancy grows
logarithmically) follow at the end. The mix is the join of slots and document pieces on
(source, block), so a source with a third of all rows is many keys, not one.

Targets: sources share the words by weight; a target stops at ``max_epochs`` times its source's
words, and the excess is shared again by weight among the others until none is above.

Ranks and offsets come from two-level running totals (per hashed bucket, then inside a bucket), so
no window holds a whole source. The table of sources (one row each) is small: it is collected once
for the cascade of targets and broadcast.

Defined cases: null or empty texts have size 0 and take 0 words; null sources form one source, the
last; repeated rows are documents of their own, laid side by side in an order that cannot matter
for rows equal in every column; an empty table gives empty results; a corpus without words has
targets of 0; extra columns are ignored by ``takes`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.llm.common import WORD, broadcast_if_small, fresh, stored

POINT_BITS = 52
CELLS = 4096


@dataclass(frozen=True)
class Mix:
    block_words: int = 256
    max_epochs: int = 3
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    bucket_rows: int = 2_000
    seed: int = 0


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], max_epochs: int) -> list[float]:
    """Words for each source: by weight, at most ``max_epochs`` times its size, excess reshared."""
    limit = [float(max_epochs * s) for s in sizes]
    out = [0.0] * len(sizes)
    open_, left = [i for i, w in enumerate(weights) if w > 0], float(sum(sizes))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in open_ if share[i] > limit[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = limit[i]
            left -= limit[i]
        open_ = [i for i in open_ if i not in full]
    return out


def _sized(docs: DataFrame, options: Mix, id_column: str, text: str, source: str) -> DataFrame:
    picked = docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), words(text).alias("size")
    )
    return picked.withColumn("place", F.xxhash64("id", F.lit(options.seed)))


def plan(sized: DataFrame, options: Mix) -> tuple[DataFrame, int]:
    """(source, position, source_size, target, low, high) of every source, and the number of rows.

    ``low`` and ``high`` bound the source's interval of [0, 1) by its share of all targets. Sources
    are ordered by code point (the order of UTF-8 bytes), null last; weights repeat along it.
    """
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.n for r in found]
    weights = [options.weights[i % len(options.weights)] for i in range(len(found))]
    goal = targets(sizes, weights, options.max_epochs)
    total, at, rows = sum(goal) or 1.0, 0.0, []
    for i, (r, t) in enumerate(zip(found, goal, strict=True)):
        rows.append((r.source, i, r.n, t, at / total, (at + t) / total))
        at += t
    schema = "source string, position int, source_size long, target double, low double, high double"
    return spark.createDataFrame(rows, schema), sum(r.rows for r in found)


def schedule(sources: DataFrame, options: Mix) -> DataFrame:
    """Slots of the mix: (slot, position, block, n_words).

    ``block`` counts the source's slots; block k is words [k * b, (k + 1) * b) of its repeated line.
    """
    spark = sources.sparkSession
    b = options.block_words
    quota = sources.select(
        "position", "low", "high", F.floor("target").alias("goal"),
        F.ceil(F.floor("target") / F.lit(b)).cast("long").alias("quota"),
    )
    n_slots = int(quota.agg(F.sum("quota")).first()[0] or 0)
    # The bits of the slot number behind the point, in reverse.
    turned = F.reverse(F.lpad(F.bin("id"), POINT_BITS, "0"))
    point = F.conv(turned, 2, 10).cast("double") / F.lit(float(2**POINT_BITS))
    slots = spark.range(n_slots).select("id", point.alias("point"))
    # Points meet the interval that holds them through equal cells of [0, 1): an equi-join with at
    # most CELLS rows plus one per source.
    cells = quota.where("high > low").select(
        "position", "low", "high",
        F.explode(
            F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))
        ).alias("cell"),
    )
    drawn = (
        slots.withColumn("cell", F.floor(F.col("point") * CELLS))
        .join(F.broadcast(cells), "cell")
        .where("point >= low and point < high")
        .select(F.col("id").alias("slot"), "position", F.floor(F.col("id") / options.bucket_rows).alias("bucket"))
    )
    drawn = stored(drawn, "slots")
    totals = drawn.groupBy("position", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = totals.select("position", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("position", "bucket").orderBy("slot")) - 1
    ranked = (
        drawn.withColumn("inside", inside)
        .join(starts, ["position", "bucket"])
        .select("slot", "position", (F.col("before") + F.col("inside")).alias("block"))
    )
    # What the points leave open follows at the end, block by block.
    got = totals.groupBy("position").agg(F.sum("n").alias("got"))
    rest = (
        quota.join(got, "position", "left")
        .where(F.col("quota") > F.coalesce("got", F.lit(0)))
        .select("position", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("quota") - 1)).alias("block"))
        .select((F.lit(n_slots) + F.col("block")).alias("slot"), "position", "block")
    )
    return (
        ranked.unionByName(rest)
        .join(F.broadcast(quota.select("position", "quota", "goal")), "position")
        .where("block < quota")
        .select("slot", "position", "block", F.least(F.lit(b), F.col("goal") - F.col("block") * b).alias("n_words"))
    )


def lines(sized: DataFrame, sources: DataFrame, n_rows: int, options: Mix) -> DataFrame:
    """(id, source, size, source_size, target, position, start): where each document starts."""
    buckets = max(1, -(-n_rows // options.bucket_rows))
    placed = sized.withColumn("bucket", F.pmod(F.shiftright("place", 20), F.lit(buckets))).join(
        F.broadcast(sources.select("source", "position", "source_size", "target")).withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    totals = placed.groupBy("position", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("position").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("position", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("position", "bucket").orderBy("place", "id", "size")
    begun = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        placed.withColumn("begun", F.coalesce(begun, F.lit(0)))
        .join(starts, ["position", "bucket"])
        .withColumn("start", F.col("before") + F.col("begun"))
    )


def _taken(laid: DataFrame, slots: DataFrame, options: Mix) -> DataFrame:
    """Words taken by (position, start), which names a document with words: pieces of slots in it."""
    b = options.block_words
    rounds = F.explode(
        F.sequence(F.lit(0), F.floor((F.ceil("target") - 1) / F.greatest("source_size", F.lit(1))).cast("int"))
    )
    pieces = (
        laid.where("size > 0 and target >= 1")
        .select("position", "start", "size", "source_size", rounds.alias("round"))
        .withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
        .select("position", "start", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block"))
    )
    ends = F.least(F.col("at") + F.col("size"), F.col("block") * b + F.col("n_words"))
    return (
        pieces.join(slots.select("position", "block", "n_words"), ["position", "block"])
        .select("position", "start", F.greatest(F.lit(0), ends - F.greatest("at", F.col("block") * b)).alias("n"))
        .groupBy("position", "start")
        .agg(F.sum("n").alias("taken"))
    )


def takes(
    docs: DataFrame,
    options: Mix = Mix(),
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    sized = stored(_sized(docs, options, id_column, text, source), "sizes")
    sources, n_rows = plan(sized, options)
    laid = stored(lines(sized, sources, n_rows, options), "lines")
    taken = _taken(laid, schedule(sources, options), options)
    taken = taken.withColumnRenamed("position", "p").withColumnRenamed("start", "s")
    same = (F.col("position") == F.col("p")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("s"))
    return laid.join(taken, same, "left").select(
        F.col("id").alias(id_column), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def apply_mix(
    docs: DataFrame,
    options: Mix = Mix(),
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``.

    A document cut by the end of its source's target counts if the mix takes at least half of it.
    Documents without words are no part of the mix. Rows with the same id (and null ids) share what
    the mix takes of that id evenly.
    """
    name = fresh(docs)
    copies, other = name("copies"), name("other_id")
    count = stored(
        takes(docs, options, id_column, text, source)
        .groupBy(F.col(id_column).alias(other))
        .agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias(copies))
        .where(F.col(copies) > 0),
        "copies",
    )
    joined = docs.join(broadcast_if_small(count), F.col(id_column).eqNullSafe(F.col(other)))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
