"""Single records: mappings under published or own names become a DataFrame of the raw schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import COLUMNS

#: Of each field, the names under which a record may have it, the published one first. Amounts stay texts, to tell unreadable from missing.
ALIASES = {own: (name, own) for name, own in COLUMNS.items()} | {"consortium_size": ("consortium_size",)}
SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(own, T.LongType() if own in ("contract_id", "consortium_size") else T.StringType()) for own in ALIASES)])


def value(record: Mapping[str, Any], own: str) -> Any:
    """The first name that the record has decides, even if its value is missing."""
    for name in ALIASES[own]:
        if name in record:
            x = record[name]
            return None if x is None or x != x or (isinstance(x, str) and not x.strip()) else x
    return None


def from_records(spark: SparkSession, records: Iterable[Mapping[str, Any]]) -> DataFrame:
    """A row for each record, in their order by row_id."""
    rows = []
    for k, record in enumerate(records):
        own = [value(record, name) for name in ALIASES]
        rows.append((k, *(None if x is None else int(x) if f.dataType == T.LongType() else repr(x) if isinstance(x, float) else str(x) for x, f in zip(own, SCHEMA.fields[1:], strict=True))))
    return spark.createDataFrame(rows, SCHEMA)
