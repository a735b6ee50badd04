"""Files: the published extract with a fixed schema, its Parquet cache, and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COLUMNS

_TYPES = {"amount_usd": T.DoubleType(), "contract_id": T.LongType()}
PUBLISHED = T.StructType([T.StructField(name, _TYPES.get(own, T.StringType())) for name, own in COLUMNS.items()])
RAW = T.StructType([T.StructField(own, _TYPES.get(own, T.StringType())) for own in COLUMNS.values()])


def _status(spark: SparkSession, path: str):
    """The file system's entry for a path, by Hadoop, so that any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(where) if fs.exists(where) else None


def _fingerprint(spark: SparkSession, path: str) -> str:
    entry = _status(spark, path)
    return f"{entry.getPath().getName()}:{entry.getLen()}:{entry.getModificationTime()}"


def check_header(names: list[str]) -> None:
    """ValueError unless the names are exactly those of the published extract."""
    more, less = sorted(set(names) - set(COLUMNS)), sorted(set(COLUMNS) - set(names))
    if more or less:
        raise ValueError(f"columns don't fit: unexpected {more}, missing {less}")


def rename(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{name}`").alias(own) for name, own in COLUMNS.items()))


def read_csv(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = ()) -> DataFrame:
    """The extract under the names used here, every value as published.

    na_tokens: further texts to read as missing; by default only empty fields are, so that the code NA stays a code.
    """
    if _status(spark, path) is None:
        raise FileNotFoundError(path)
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path, inferSchema=False).columns
    check_header(names)
    schema = T.StructType([PUBLISHED[n] for n in names])
    df = rename(spark.read.options(**options).option("mode", "FAILFAST").schema(schema).csv(path))
    if na_tokens:
        df = df.select(*(F.when(~F.col(f.name).isin(*na_tokens), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))
    return df


def load(spark: SparkSession, path: str, cache: str | None = None, **options) -> DataFrame:
    """The extract; with a cache, from its Parquet copy while the file's name, size and time are those of the copy."""
    if cache is None:
        return read_csv(spark, path, **options)
    if _status(spark, path) is None:
        raise FileNotFoundError(path)
    own, manifest = _fingerprint(spark, path), f"{cache.rstrip('/')}.manifest"
    if _status(spark, manifest) is not None and _status(spark, cache) is not None and spark.read.schema("fingerprint string").json(manifest).first()[0] == own:
        return spark.read.parquet(cache)
    read_csv(spark, path, **options).write.mode("overwrite").parquet(cache)
    spark.createDataFrame([(own,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(manifest)
    return spark.read.parquet(cache)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """one_file: for small tables, such as the register of flags."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Audit records as lines of JSON, with their nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame, name: str = "audit_json") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))

