from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from rungwise import session

REPO = Path(__file__).resolve().parents[1]


class Elsewhere:
    """A session of a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_scratch_is_fresh_and_can_be_cleaned(spark):
    path = session.scratch_path(spark, "probe")
    assert path != session.scratch_path(spark, "probe") and path.startswith(session.shared_dir(spark))
    kept, session._SCRATCH[:] = session._SCRATCH[:-2], [path]
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:"))
    assert session.clean_scratch(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._SCRATCH[:] = kept


def test_settings_of_the_caller_stay(spark):
    session.apply_settings(spark)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    session.apply_settings(spark)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_a_projection_runs_from_a_foreign_folder(tmp_path, small_dir):
    """Executors get the package from the driver, wherever they start."""
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r})\n"
        "from rungwise.session import local_session\n"
        "from rungwise.workload.catalogue import all_queries\n"
        "spark = local_session(2, 2)\n"
        f"print('rows', all_queries()['iso1_ladder_projection'][0](spark, {small_dir!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.rsplit("rows", 1)[1]) > 0
