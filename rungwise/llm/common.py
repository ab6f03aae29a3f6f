"""Helpers shared by the text operators: tables, Arrow kernels, stored steps, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.session import scratch_path, ship

#: Words of all contracts: runs of anything but ASCII white space. ``bytes.split()`` cuts there too.
WORD = r"[^\x20\x09-\x0D]+"

#: An Arrow batch holds at most so many bytes of rows (one row may be longer).
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Tables of at most so many narrow rows, counted first, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(
    df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so long texts do not pile up in a worker."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_SETTING, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(kernel, schema)


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: cuts the lineage, survives lost executors.

    Rows are dealt into one folder per value of the columns ``folders``, if any are named.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(*frames: DataFrame) -> Callable[[str], str]:
    """A namer of helper columns that clash with none of the frames' own columns."""
    taken = {c.lower() for f in frames for c in f.columns}

    def name(stem: str) -> str:
        while stem.lower() in taken:
            stem = f"_{stem}"
        return stem

    return name


def held_out(id_column: str):
    """True for ids kept out of training: crc32 of the id's text mod 5 is 0 (a null id counts so)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` (narrow, cheap to count) holds at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _stars(e: DataFrame) -> bool:
    """Is every node with a smaller neighbour (a) joined to just one, which has no smaller itself?"""
    several = e.groupBy("a").agg((F.min("b") != F.max("b")).alias("bad")).where("bad").select("a")
    chained = e.select("a").join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Smallest node reachable from each node: (``node``, component_id).

    ``edges`` has columns (a, b) of node values; self links and nulls are ignored, repeats are
    harmless. Alternating large-star and small-star steps (Kiveris et al., 2014): every step keeps
    the number of edges within those it got, and each is written to the shared folder, so no group
    and no component is ever gathered in one place. Edges of a hub are combined map-side (minimum),
    the join back to them is a plain one that the adaptive planner may split.
    """
    e = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    while not _stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = stored(large, "large-star")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        e = stored(small, "small-star")
    found = e.select(F.col("a").alias(node), F.col("b").alias("_component"))
    return nodes.select(node).join(found, node, "left").select(
        node, F.coalesce("_component", node).alias("component_id")
    )


def run_id() -> str:
    return uuid.uuid4().hex
