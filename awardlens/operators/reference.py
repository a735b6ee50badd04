"""The fitted reference: four ladders of benchmarks and the contracts that history is counted from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.calendar import month_number
from ..plans.stored import small
from . import clean, vintages


@dataclass(frozen=True)
class Reference:
    """Tables by name; version and the range of months belong to them."""

    ladders: dict[str, DataFrame]
    events: DataFrame
    version: str
    months: tuple[int, int] | None = None

    def save(self, path: str) -> None:
        """One Parquet table each, and a manifest of one row."""
        for name, table in self.ladders.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        self.events.write.mode("overwrite").parquet(f"{path}/events")
        lo, hi = self.months or (None, None)
        self.events.sparkSession.createDataFrame([(self.version, lo, hi)], "version string, first_month int, last_month int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Reference:
    version, lo, hi = spark.read.parquet(f"{path}/manifest").first()
    return Reference({n: spark.read.parquet(f"{path}/{n}") for n in vintages.LADDERS}, spark.read.parquet(f"{path}/events"), version, None if lo is None else (lo, hi))


#: A ladder of up to so many cells, about 1 KB each, is sent to every executor.
BROADCAST_CELLS = 32_768


def plan(cleaned: DataFrame, config: EngineConfig = DEFAULT, approximate: bool = False, keep: Callable[[DataFrame, str], DataFrame] = lambda table, name: table) -> Reference:
    """The reference as plans, nothing run yet but what keep does with the contracts, which four ladders and the history read, and with the ladders.

    Kept ladders of up to BROADCAST_CELLS are broadcast, so that the rows that are looked up in them aren't shuffled.
    """

    def kept(name: str, cells: DataFrame) -> DataFrame:
        table = keep(cells, f"cells-{name}")
        return table if table is cells else small(table, BROADCAST_CELLS)

    contracts = keep(clean.usable(clean.contract_grain(cleaned)).select("procurement_category", "region", "global_practice", "supplier_key", "project_id", "signing_date", "amount_usd"), "contracts")
    events = clean.usable(cleaned) if config.history_grain == "row" else contracts
    ladders = {n: kept(n, vintages.build(contracts, keys, config, approximate)) for n, keys in vintages.LADDERS.items()}
    return Reference(ladders, events.select("supplier_key", "project_id", "signing_date"), config.version)


def fit(cleaned: DataFrame, config: EngineConfig = DEFAULT, approximate: bool = False) -> Reference:
    """The reference with its months; ValueError if no contract is usable."""
    made = plan(cleaned, config, approximate)
    m = month_number("signing_date")
    lo, hi = made.events.agg(F.min(m), F.max(m)).first()
    if lo is None:
        raise ValueError("no usable contract to fit the reference to")
    return Reference(made.ladders, made.events, made.version, (lo, hi))
