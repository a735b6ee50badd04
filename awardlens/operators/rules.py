"""The rule engine. SQL's three-valued AND is the logic of the rules: false wins over unknown, unknown over true."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .flags import FATAL, with_severity

#: Cohorts by precedence; the lower one wins.
COHORTS = ("NOT_ELIGIBLE", "EXCEPTIONAL", "HIGH_ATTENTION", "ROUTINE")
NOT_ELIGIBLE, EXCEPTIONAL, HIGH_ATTENTION, ROUTINE = range(4)
UNEVALUABLE = "UNEVALUABLE::"


@dataclass(frozen=True)
class Rule:
    """predicate: a condition over the features' columns, made from the settings when a plan is built."""

    id: str
    condition: str
    threshold: Callable[[EngineConfig], str]
    predicate: Callable[[EngineConfig], Column]
    why: str
    cohort: int = EXCEPTIONAL
    active: bool = True


RULES = (
    Rule("AMOUNT_EXTREME_FOR_PEER_GROUP", "The amount is over a multiple of the peer group's median at signing.", lambda c: f"ratio > {c.amount_multiple:g}", lambda c: F.col("amount_vs_category_region_median") > c.amount_multiple, "So unlike its peers that someone should look before it goes on."),
    Rule("NON_COMPETITIVE_HIGH_VALUE", "No competition, and a large amount.", lambda c: f"amount > {c.non_competitive_amount:,.0f}", lambda c: ~F.col("is_competitive_method") & (F.col("amount_usd") > c.non_competitive_amount), "A large sum rests on a choice that no other offer tested."),
    Rule("OFFSHORE_SUPPLIER_FOREIGN_TO_BORROWER", "The supplier is in a secrecy jurisdiction and not in the borrower's country.", lambda c: f"one of {len(c.secrecy)} jurisdictions", lambda c: F.col("supplier_in_secrecy_jurisdiction") & ~F.col("supplier_is_domestic"), "Its owners can't be established."),
    Rule("FIRST_CONTRACT_IN_PROJECT_HIGH_VALUE", "No earlier contract in the project, and a multiple of the median.", lambda c: f"first and ratio > {c.first_contract_ratio:g}", lambda c: F.col("is_first_contract_in_project") & (F.col("amount_vs_category_region_median") > c.first_contract_ratio), "The first award sets the pattern of those to come."),
    Rule("SIGNED_OUTSIDE_FISCAL_YEAR_WINDOW", "The signing date is outside its fiscal year.", lambda c: "day 0 to 366", lambda c: ~F.col("days_into_fiscal_year").between(0, 366), "Can't fire while the fiscal year is taken from the signing date.", active=False),
)


def apply(rows: DataFrame, config: EngineConfig = DEFAULT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Validated rows with cohort_rank (NULL: left to the model), triggered, rule_reasons and undecidable.

    Not fit for assessment: NOT_ELIGIBLE. Any rule true: EXCEPTIONAL. Else any rule unknown: HIGH_ATTENTION.
    """
    made = [(r.id, r.predicate(config)) for r in rules]
    fatal = with_severity("data_quality_flags", FATAL)
    true = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in made)))
    unknown = F.array_compact(F.array(*(F.when(p.isNull(), F.lit(n)) for n, p in made)))
    rows = rows.withColumn("_true", true).withColumn("_unknown", unknown)
    none = F.array().cast("array<string>")
    fired, unsure = F.size("_true") > 0, F.size("_unknown") > 0
    return rows.withColumns(
        {
            "cohort_rank": F.when(~F.col("ok"), NOT_ELIGIBLE).when(fired, EXCEPTIONAL).when(unsure, HIGH_ATTENTION),
            "triggered": F.when(~F.col("ok"), F.transform(fatal, lambda f: F.concat(F.lit("NOT_ELIGIBLE::"), f))).otherwise(F.col("_true")),
            "rule_reasons": F.when(~F.col("ok"), fatal).when(fired, F.col("_true")).when(unsure, F.transform("_unknown", lambda n: F.concat(F.lit(UNEVALUABLE), n))).otherwise(none),
            "undecidable": F.when(F.col("ok"), F.col("_unknown")).otherwise(none),
        }
    ).drop("_true", "_unknown")


def cohort_name(rank: Column | str) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.get(F.array(*map(F.lit, COHORTS)), rank)


def override(rank: Column, anomalous: Column) -> Column:
    """An anomalous record is HIGH_ATTENTION at least; none moves down."""
    return F.when(anomalous, F.least(rank, F.lit(HIGH_ATTENTION))).otherwise(rank)


def catalogue(spark: SparkSession, config: EngineConfig = DEFAULT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.id, COHORTS[r.cohort], "active" if r.active else "inactive", r.condition, r.threshold(config), r.why) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, cohort string, status string, condition string, threshold string, why string")
