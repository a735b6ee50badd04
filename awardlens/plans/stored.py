"""Tables that one plan reads many times, written once."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many rows are sent to every executor, so that what they are joined to isn't shuffled.
BROADCAST_ROWS = 2_000_000
#: Spark deletes a statement's shuffle files when the statement ends, and not whenever the driver's garbage is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def place(spark: SparkSession, name: str) -> str | None:
    """A path for a new table that all executors see, or None.

    It is in the shared folder that spark.checkpoint.dir names. Where that is unset, a local session has a folder of its
    own, deleted at exit, and a cluster none, as executors would not see the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            return None
        folder = tempfile.mkdtemp(prefix="awardlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/awardlens-{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet and read from there, so that its uses don't each plan and scan it again; without a place it stays a plan.

    The shuffle files of what made it go when it is written.
    """
    spark = table.sparkSession
    path = place(spark, name)
    if path is None:
        return table
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        table.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(table.schema).parquet(path)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast when it has no more rows than that; it is counted for this, so it should be files or few joins."""
    return F.broadcast(table) if table.count() <= rows else table
