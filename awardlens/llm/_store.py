"""Places for the tables that operators write between their steps."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where it is unset, as in tests, a folder of the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/awardlens-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a batch that goes to Python; texts may be long, and a batch is held in memory on both sides.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches of BATCH_ROWS at most."""
    now = int(spark.conf.get(_ROWS))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark


#: Spark deletes a statement's shuffle files when the statement ends, and not whenever the driver's garbage is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(table: DataFrame, path: str, **options) -> DataFrame:
    """Write the table as Parquet at path and read it from there: what made it isn't run again, and its shuffle files go.

    The driver's garbage is collected before, so that files of finished statements elsewhere aren't on the disks as well.
    """
    spark = table.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        table.write.mode("overwrite").options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(table.schema).parquet(path)


def kept(table: DataFrame, name: str) -> DataFrame:
    """The table, written to a new place and read from there."""
    return write(table, place(table.sparkSession, name))


class Scratch:
    """The written steps of one run of an operator, each deleted when no later step reads it."""

    def __init__(self, name: str):
        self.name, self.paths = name, {}

    def kept(self, step: str, table: DataFrame) -> DataFrame:
        path = place(table.sparkSession, f"{self.name}-{step}")
        self.paths.setdefault(step, []).append(path)
        self.spark = table.sparkSession
        return write(table, path)

    def drop(self, *steps: str, but: tuple[str, ...] = ()) -> None:
        """Delete these steps' tables; without names, all but those of ``but``."""
        for step in steps or [x for x in self.paths if x not in but]:
            for path in self.paths.pop(step, []):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct, row, so that names of any kind can't clash with those of a step."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def filtered(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The documents for whose texts keep gives true, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(0).field(at)), pa.bool_()))

    return docs.select(row_of(docs)).mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
