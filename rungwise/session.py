"""Session settings the plans rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings, safe to apply to a session somebody else created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Accept one more exchange when that is what splitting a skewed join partition costs.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so kernels import wherever they start.

    The driver zips its own copy and Spark's file service hands it out; nothing needs to be
    installed on the executors and the working folder does not matter.
    """
    context = spark.sparkContext
    if getattr(context, "_rungwise_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "rungwise.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._rungwise_shipped = True


def apply_settings(spark: SparkSession) -> SparkSession:
    """Ship the package and make the settings, once per session.

    What the caller set when building the session stays, but for the time zone: timestamps without
    a zone mean UTC in every table.
    """
    ship(spark)
    if getattr(spark, "_rungwise_settings", False):
        return spark
    chosen = spark.sparkContext.getConf()
    for name, value in SQL_SETTINGS.items():
        if name == "spark.sql.session.timeZone" or not chosen.contains(name):
            spark.conf.set(name, value)
    spark._rungwise_settings = True
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rungwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for name, value in SQL_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one in ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may do without: it gets a temporary folder that
    goes with the process. Elsewhere a missing setting is an error, as a driver-local folder would
    be out of the executors' reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if configured is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder, until ``clean_scratch`` is called."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote under ``scratch_path``; tables read from there are gone then.

    Returns the number of paths deleted. Checkpoints are removed by Spark itself if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    conf, deleted = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        deleted += bool(path.getFileSystem(conf).delete(path, True))
    return deleted


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and freezes non-deterministic columns."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, for tables that several later steps read.

    As safe as ``checkpointed``, but column by column and compressed: each reader takes only what it
    needs. Digests in hex, half of many rows, halve only under a codec that codes single characters.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
