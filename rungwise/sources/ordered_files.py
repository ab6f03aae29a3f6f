"""The canonical order kept in files: written by one range sort, read back without sorting.

Rows lie in one folder per split, each file holding a range of the order in that order. A manifest
beside them has one row per file: its place among all files, the rows before it, how many it holds and
the keys of its first and last row. A row's place in the whole order is then the rows before its file
plus its index in the file, both known to the scan, and a stretch of the order or of time needs only
the files whose bounds meet it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.operators.ordered import small
from rungwise.operators.select import canonical_keys
from rungwise.session import written

BOUNDS = ("scheduled_time", "event_id", "horizon_seconds", "threshold", "market_id")
_FILE = "concat(split, '/', _metadata.file_name)"


def write(
    rows: DataFrame, splits: Mapping[str, tuple[str, str]], path: str, rows_per_file: int = 1_000_000
) -> None:
    """``rows`` in canonical order under ``path/rows``, and ``path/manifest``."""
    spark = rows.sparkSession
    known = rows.where(F.col("split").isin(*splits))
    keys = canonical_keys(splits)
    # The writer wants each task's rows sorted by the folder's column; were it not the first key, it
    # would sort by it alone and lose the order of the rest.
    sorted_ = known.repartitionByRange(*keys).sortWithinPartitions("split", *keys)
    sorted_.write.mode("error").option("maxRecordsPerFile", rows_per_file).partitionBy("split").parquet(f"{path}/rows")
    # An empty file keeps the columns, should there be no rows.
    known.where("false").coalesce(1).write.mode("error").parquet(f"{path}/columns")
    index = F.expr("_metadata.row_index")
    bounds = F.struct(*BOUNDS)
    files = (
        spark.read.schema(rows.schema).parquet(f"{path}/rows")
        .select("split", F.expr(_FILE).alias("file"), index.alias("i"), bounds.alias("key"))
        .groupBy("split", "file")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "i").alias("first"), F.max_by("key", "i").alias("last"))
    )
    # Parts are named in the order of the ranges, a task's files in the order of its rows.
    order = F.struct(F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")), "file")
    numbered = written(files.withColumn("order", order), "files")
    before = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: far fewer than any table that a task holds.
    manifest = numbered.select(
        F.row_number().over(Window.orderBy("order")).alias("place"), "file", "split", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "first", "last",
    )
    manifest.write.mode("error").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(place, file, split, n, before, first, last) of every file."""
    return spark.read.parquet(f"{path}/manifest")


def _reader(spark: SparkSession, path: str):
    schema = spark.read.parquet(f"{path}/columns").schema
    inner = [f for f in schema.fields if f.name != "split"]
    schema = type(schema)([*inner, schema["split"]])
    return spark.read.schema(schema).option("basePath", f"{path}/rows")


def _files(listed: DataFrame, path: str) -> list[str]:
    found = listed.orderBy("place").select("file").collect()
    return [f"{path}/rows/split={r.file}" for r in found]


def with_places(spark: SparkSession, path: str, listed: DataFrame | None = None, name: str = "position") -> DataFrame:
    """The rows with their place in the whole order (from 0), of all files or of those ``listed``."""
    chosen = manifest(spark, path) if listed is None else listed
    n_files = chosen.count()
    if listed is None or not n_files:
        rows = _reader(spark, path).parquet(f"{path}/rows").where(F.lit(listed is None))
    else:
        rows = _reader(spark, path).parquet(*_files(listed, path))
    placed = rows.select("*", F.expr(_FILE).alias("_file"), F.expr("_metadata.row_index").alias("_index"))
    starts = small(chosen.select(F.col("file").alias("_file"), F.col("before").alias("_before")), n_files)
    return placed.join(starts, "_file").withColumn(name, F.col("_before") + F.col("_index")).drop("_file", "_index", "_before")


def stretch(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows at the places ``first`` to ``last`` (inclusive), from the files that hold them."""
    held = manifest(spark, path).where((F.col("before") <= last) & (F.col("before") + F.col("n") > first))
    return with_places(spark, path, held).where(F.col("position").between(first, last))


def between(spark: SparkSession, path: str, start: str, end: str, splits: Sequence[str] = ()) -> DataFrame:
    """Rows scheduled in [start, end), from the files whose bounds meet that time."""
    held = manifest(spark, path).where((F.col("last.scheduled_time") >= F.lit(start)) & (F.col("first.scheduled_time") < F.lit(end)))
    if splits:
        held = held.where(F.col("split").isin(*splits))
    when = F.col("scheduled_time")
    return with_places(spark, path, held).where((when >= F.lit(start)) & (when < F.lit(end)))


def in_order(spark: SparkSession, path: str) -> Iterator[Row]:
    """All rows in canonical order, one file after the other; the caller holds a file's rows at most."""
    for file in _files(manifest(spark, path), path):
        rows = _reader(spark, path).parquet(file)
        yield from rows.select("*", F.expr("_metadata.row_index").alias("_index")).orderBy("_index").drop("_index").toLocalIterator()
