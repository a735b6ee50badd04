"""From raw rows to audit records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, EngineConfig
from ..operators import anomaly, clean, cohort, features, flags, metrics, model, reference, rules
from ..sources import records as R
from .stored import stored


def _prepared(raw: DataFrame, config: EngineConfig, approximate: bool = False) -> tuple[DataFrame, reference.Reference]:
    """The cleaned rows and the reference made of them, as written tables."""
    cleaned = stored(clean.marked(clean.clean(raw, config)), "cleaned")
    return cleaned.drop(clean.FIRST), reference.plan(cleaned, config, approximate, stored)


def validated(raw: DataFrame, config: EngineConfig = DEFAULT, approximate: bool = False) -> tuple[DataFrame, reference.Reference]:
    """The validated rows of a batch, with the reference made of it. Every statistic reads only the past, so there is no other fit.

    Cleaned rows, the contracts that statistics read and the ladders are written once, each without the shuffle files of the step before.
    """
    cleaned, made = _prepared(raw, config, approximate)
    return flags.validate_batch(cleaned, made, config), made


def feature_table(raw: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return features.engineer(*_prepared(raw, config), config)


def eligible(checked: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The rows that the rules leave to the model."""
    return rules.apply(checked, config).filter("cohort_rank is null")


def train(checked: DataFrame, made: reference.Reference, config: EngineConfig = DEFAULT, kind: str = "gbt", **options) -> cohort.Artefacts:
    """Model and detector, fitted to the training years of the eligible rows."""
    parts = metrics.split(eligible(checked, config), config)
    fitted = model.train(parts["train"], parts["validate"], kind, config=config, **options)
    return cohort.Artefacts(made, fitted, anomaly.fit(parts["train"], config), config)


def classify_batch(raw: DataFrame, artefacts: cohort.Artefacts, timestamp: datetime) -> DataFrame:
    cleaned = clean.clean(raw, artefacts.config)
    return cohort.classify(flags.validate_batch(cleaned, artefacts.reference, artefacts.config), artefacts, timestamp)


def classify_records(spark: SparkSession, records: Iterable[Mapping[str, Any]], artefacts: cohort.Artefacts, timestamp: datetime) -> DataFrame:
    """The same for mappings under published or own names. Without consortium_size the size is unknown."""
    checked = flags.enrich(R.from_records(spark, records), artefacts.reference, artefacts.config)
    return cohort.classify(checked, artefacts, timestamp)


def classify_contract(spark: SparkSession, record: Mapping[str, Any], artefacts: cohort.Artefacts, timestamp: datetime) -> dict:
    """One record's audit record. If the plan fails with the model, it runs again without, which is HIGH_ATTENTION."""
    try:
        row = classify_records(spark, [record], artefacts, timestamp).first()
    except ValueError:
        raise
    except Exception:
        row = classify_records(spark, [record], replace(artefacts, model=None, detector=None, config=replace(artefacts.config, require_detector=True)), timestamp).first()
    return {k: v for k, v in row.asDict(True).items() if k not in ("row_id", "contract_id")}
