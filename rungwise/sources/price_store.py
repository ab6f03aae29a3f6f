"""Price histories stored for as-of selection: written once, asked by any number of cutoff tables.

Two bucketed tables in the shared folder (or any other). ``<name>_days`` has one row per token and
time bucket with its points in order; ``<name>_tokens`` has one row per token: the time of its first
conflict, and of each of its buckets the last point. A cutoff meets one row of each, by equality, and
finds its place by binary search in the row's arrays. So neither stored table is ever shuffled or
sorted again, whatever is asked; only the cutoffs move, to where the files already are.

A token with a large share of all points is many rows of ``days``. Its row in ``tokens`` has one entry
per time bucket (a year of days is 365), so both kinds of rows are bounded by the calendar, if
timestamps are whole seconds.

Defined cases: points without token, time or value are left out; copies collapse; of two values at
one time the smaller one is kept and the time counts as a conflict; null tokens and cutoffs are not
asked; an empty store answers that there is no point. A store holds one history; another load of
points is another store.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.operators import asof
from rungwise.session import scratch_path

#: Steps of the binary search: arrays of up to 2**20 points (a second each makes 12 days).
STEPS = 20


@dataclass(frozen=True)
class PriceStore:
    """Where a store lies and how it is dealt; ``days`` and ``tokens`` are tables of the session."""

    name: str
    path: str
    files: int
    bucket_seconds: int

    @property
    def days(self) -> str:
        return f"{self.name}_days"

    @property
    def tokens(self) -> str:
        return f"{self.name}_tokens"


def _declare(spark: SparkSession, store: PriceStore) -> None:
    """Make the store's tables known to the session; their data stay where they are."""
    layout = {
        store.days: ("token string, bucket bigint, ats array<bigint>, ps array<double>", "token, bucket"),
        store.tokens: (
            "token string, first_conflict bigint, buckets array<bigint>, ats array<bigint>, ps array<double>", "token",
        ),
    }
    for table, (columns, keys) in layout.items():
        spark.sql(
            f"create table if not exists {table} ({columns}) using parquet clustered by ({keys}) "
            f"sorted by ({keys}) into {store.files} buckets location '{store.path}/{table}'"
        )


def write(points: DataFrame, path: str, files: int, bucket_seconds: int = asof.DAY_SECONDS) -> PriceStore:
    """Store ``points`` (token, ts, p) under a fresh ``path`` in ``files`` files per table."""
    spark = points.sparkSession
    name = "prices_" + "".join(c if c.isalnum() else "_" for c in path.rstrip("/").rsplit("/", 1)[-1])
    store = PriceStore(name.lower(), path.rstrip("/"), files, bucket_seconds)
    _declare(spark, store)
    clean = asof.distinct_points(points.where("p is not null"), bucket_seconds)
    ordered = F.array_sort(F.collect_list(F.struct("at", "p")))
    days = clean.groupBy("token", "bucket").agg(ordered.alias("x"))
    days = days.select("token", "bucket", F.col("x.at").alias("ats"), F.col("x.p").alias("ps"))
    days.repartition(files, "token", "bucket").write.insertInto(store.days)
    conflicts = clean.where("conflict").groupBy("token").agg(F.min("at").alias("first_conflict"))
    last = F.struct("bucket", F.element_at("ats", -1).alias("at"), F.element_at("ps", -1).alias("p"))
    closing = spark.table(store.days).groupBy("token").agg(F.array_sort(F.collect_list(last)).alias("x"))
    tokens = closing.join(conflicts, "token", "left").select(
        "token", "first_conflict", F.col("x.bucket").alias("buckets"), F.col("x.at").alias("ats"), F.col("x.p").alias("ps")
    )
    tokens.repartition(files, "token").write.insertInto(store.tokens)
    spark.createDataFrame([(json.dumps(asdict(store)),)], "value string").coalesce(1).write.text(f"{store.path}/store")
    return store


def attach(spark: SparkSession, path: str) -> PriceStore:
    """A store that an earlier session wrote."""
    store = PriceStore(**json.loads(spark.read.text(f"{path.rstrip('/')}/store").first().value))
    _declare(spark, store)
    return store


def stored(points: DataFrame, bucket_seconds: int = asof.DAY_SECONDS) -> PriceStore:
    """A store in the shared folder, with as many files as the session has shuffle partitions."""
    spark = points.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write(points, scratch_path(spark, "prices"), files, bucket_seconds)


def count_upto(values: str, limit: Column, steps: int = STEPS) -> Column:
    """How many entries of a sorted array are not above ``limit``, by binary search."""
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(steps + 1))])
    return F.aggregate(
        widths,
        F.lit(0),
        lambda found, width: F.when(F.get(F.col(values), found + width - 1) <= limit, found + width).otherwise(found),
    )


def latest_at_or_before(spark: SparkSession, store: PriceStore, cutoffs: DataFrame) -> DataFrame:
    """As ``asof.latest_at_or_before``, from a store: token, cutoff, point_at, p, age_micros, conflict."""
    width = store.bucket_seconds * asof.MICROS
    asked = (
        cutoffs.where("token is not null and cutoff is not null")
        .select("token", F.col("cutoff").cast("timestamp").alias("cutoff"))
        .distinct()
        .withColumn("at", asof.micros("cutoff"))
        .withColumn("bucket", F.floor(F.col("at") / width))
    )
    # The merge hint keeps a small cutoff table from turning the stored side into a broadcast.
    tokens = spark.table(store.tokens).withColumnsRenamed({"ats": "last_ats", "ps": "last_ps"})
    before = F.col("upto") - 1
    known = (
        asked.hint("merge").join(tokens, "token", "left")
        .withColumn("upto", count_upto("buckets", F.col("bucket") - 1))
        .select(
            "token", "cutoff", "at", "bucket",
            F.coalesce(F.col("first_conflict") <= F.col("at"), F.lit(False)).alias("conflict"),
            F.when(before >= 0, F.get("last_ats", before)).alias("carried_at"),
            F.when(before >= 0, F.get("last_ps", before)).alias("carried_p"),
        )
    )
    inside = F.col("inside") - 1
    return (
        known.hint("merge").join(spark.table(store.days), ["token", "bucket"], "left")
        .withColumn("inside", count_upto("ats", F.col("at")))
        .select(
            "token", "cutoff", "at", "conflict",
            F.when(inside >= 0, F.get("ats", inside)).otherwise(F.col("carried_at")).alias("point_at"),
            F.when(inside >= 0, F.get("ps", inside)).otherwise(F.col("carried_p")).alias("p"),
        )
        .select("token", "cutoff", "point_at", "p", (F.col("at") - F.col("point_at")).alias("age_micros"), "conflict")
    )


def decisions(
    spark: SparkSession, store: PriceStore, cutoffs: DataFrame, max_staleness_seconds: int
) -> DataFrame:
    """As ``asof.asof_decisions``, from a store."""
    return asof.decided(latest_at_or_before(spark, store, cutoffs), max_staleness_seconds)
