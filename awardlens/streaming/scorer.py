"""Classification of a stream of raw records against fixed artefacts."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import cohort, flags


def classify_stream(records: DataFrame, artefacts: cohort.Artefacts, path: str, checkpoint: str, trigger: dict | None = None, clock=lambda: datetime.now(UTC)) -> StreamingQuery:
    """Write the audit records of each micro-batch to Parquet under path/batch=<id>.

    The history that records are compared with is the artefacts'; a batch that is tried again overwrites its own folder,
    so each record is written once.
    """

    def each(batch: DataFrame, number: int) -> None:
        checked = flags.enrich(batch, artefacts.reference, artefacts.config)
        cohort.classify(checked, artefacts, clock()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
