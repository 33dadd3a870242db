"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfgrid.constants import MAX_BROADCAST_ROWS

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # two rasters that both lie hashed on pass_id join on (pass_id, y, x) without a shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are laid out for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=1)
def _local_base() -> str:
    """One temporary folder for a local session, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="turfgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder is `spark.checkpoint.dir`. Only a local session may go without it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def task_count(table: DataFrame, rows_per_task: int = 20_000) -> int:
    """Number of tasks for a job that multiplies the rows of a table: by its rows, and at least four per core."""
    return max(-(-table.count() // rows_per_task), 4 * table.sparkSession.sparkContext.defaultParallelism)


def broadcast_if_small(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table whose row count is checked first; leave a larger one to the planner."""
    small = table.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(table) if small else table
