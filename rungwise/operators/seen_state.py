"""First-seen rows over windows that land one after the other.

The state is a table of what was seen: id, fingerprints, how often, where first, and the payload kept,
one row per distinct content and window. It is bucketed by id: a new window's contents are counted
first (copies shrink in their tasks), moved to their buckets once, and meet the stored rows where both
lie. Landing appends; nothing is written anew.

An id whose decision-relevant content differs from what was seen before is fatal, and then nothing of
the window is kept. A window lands once: its name is kept with its rows, and landing it again is an
error, so a job that runs again after a failure cannot count pages twice.

Defined cases: positions decide what was first, whatever the order of landing; null ids are one id;
an empty window lands and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.operators.quality import DataQualityError
from rungwise.operators.select import contents_of, merged_contents, per_id
from rungwise.session import scratch_path


@dataclass(frozen=True)
class SeenState:
    """A table of the session over files under ``path``, in ``files`` buckets."""

    table: str
    path: str
    files: int


def open_state(pages: DataFrame, order: Sequence[str], path: str, files: int) -> SeenState:
    """The state under ``path`` for pages like these, empty if nothing has landed there yet."""
    spark, path = pages.sparkSession, path.rstrip("/")
    name = "seen_" + "".join(c if c.isalnum() else "_" for c in path.rsplit("/", 1)[-1]).lower()
    fields = contents_of(pages, order).schema.fields
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"create table if not exists {name} (landed string, {columns}) using parquet "
        f"clustered by (id) into {files} buckets location '{path}'"
    )
    return SeenState(name, path, files)


def new_state(pages: DataFrame, order: Sequence[str]) -> SeenState:
    """An empty state in the shared folder."""
    spark = pages.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return open_state(pages, order, scratch_path(spark, "seen"), files)


def seen_before(spark: SparkSession, state: SeenState) -> DataFrame:
    """All that has landed, one row per distinct content. Does not move stored rows."""
    return merged_contents(spark.table(state.table).drop("landed"))


def first_seen(spark: SparkSession, state: SeenState) -> DataFrame:
    """As ``select.first_seen`` over all windows that have landed."""
    return per_id(seen_before(spark, state))


def land(state: SeenState, pages: DataFrame, order: Sequence[str], window: str) -> DataFrame:
    """Add a window; returns ``select.first_seen`` of its ids over everything up to it.

    Raises, and keeps nothing of the window, if an id changed. The window's contents are moved to the
    buckets of the state once and kept there under a table of their own; the check and the landing
    read them in place.
    """
    spark = pages.sparkSession
    before = [r.landed for r in spark.table(state.table).select("landed").distinct().collect()]
    if window in before:
        raise ValueError(f"window {window!r} has landed before")
    contents = _bucketed(contents_of(pages, order), state.files)
    changed = [r.id for r in _changed(spark, state, contents).select("id").limit(5).collect()]
    if changed:
        raise DataQualityError(f"seen again with other decision-relevant fields: {changed}")
    contents.select(F.lit(window).alias("landed"), *contents.columns).write.insertInto(state.table)
    up_to = spark.table(state.table).where(F.col("landed").isin([*before, window])).drop("landed")
    ids = contents.select(F.col("id").alias("_id")).distinct()
    known = merged_contents(up_to)
    # Plain equality finds the stored rows where they lie; the null id, if shown, comes beside.
    again = known.join(ids, F.col("id") == F.col("_id"), "left_semi")
    if not ids.where("_id is null").isEmpty():
        again = again.unionByName(known.where("id is null"))
    return per_id(again)


def _bucketed(contents: DataFrame, files: int) -> DataFrame:
    """``contents`` as a table of the session in the shared folder, in buckets like those of the state."""
    spark = contents.sparkSession
    path = scratch_path(spark, "window")
    name = "window_" + "".join(c for c in path[-32:] if c.isalnum())
    moved = contents.repartition(files, "id")
    moved.write.format("parquet").bucketBy(files, "id").option("path", path).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: files outside the warehouse stay
    return kept


def _changed(spark: SparkSession, state: SeenState, contents: DataFrame) -> DataFrame:
    """Ids of the window with more than one selection, in it or against the state.

    Smallest and largest selection of an id, on both sides where the rows lie.
    """
    extremes = [F.min("selection").alias("low"), F.max("selection").alias("high")]
    shown = contents.groupBy("id").agg(*extremes)
    stored = spark.table(state.table).groupBy(F.col("id").alias("_id")).agg(
        F.min("selection").alias("_low"), F.max("selection").alias("_high")
    )
    both = shown.join(stored, F.col("id") == F.col("_id"), "left")
    null_id = stored.where("_id is null").join(shown.where("id is null"), F.lit(True))
    differs = (F.least("low", "_low") != F.greatest("high", "_high"))
    return both.where(differs).select("id").unionByName(null_id.where(differs).select("id"))
