"""The 16 features and what they are looked up in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.calendar import month_number
from . import history, vintages
from .reference import Reference

FEATURES = (
    "amount_usd", "log_amount", "amount_vs_category_region_median", "amount_vs_practice_median", "amount_percentile_in_category_region",
    "benchmark_support_n", "supplier_is_domestic", "is_first_contract_in_project", "project_contract_sequence", "supplier_prior_contract_count",
    "supplier_is_known", "days_into_fiscal_year", "fy_quarter", "is_competitive_method", "supplier_in_secrecy_jurisdiction", "consortium_size",
)


def ratio(amount: str, median: str, config: EngineConfig = DEFAULT):
    return F.when(F.col(median) >= config.min_median, F.col(amount) / F.col(median))


def benchmarks(rows: DataFrame, reference: Reference, config: EngineConfig = DEFAULT) -> DataFrame:
    """benchmark_median, _support_n, _sketch and _rung (exact, category, overall, none), and practice_median with its rung.

    A rung is climbed if the one below has no cell; a null category or date has none, a null practice isn't looked up.
    """
    rows = rows.withColumn("_m", month_number(F.date_add("signing_date", config.assessment_lag_days)))
    for prefix, ladder in (("_e", "category_region"), ("_c", "category"), ("_o", "overall"), ("_p", "practice")):
        rows = vintages.lookup(rows, reference.ladders[ladder], vintages.LADDERS[ladder], prefix, config)
    able = F.col("procurement_category").isNotNull()
    rung = F.when(F.col("_e_median").isNotNull(), "exact").when(F.col("_c_median").isNotNull(), "category")
    practice = F.when(F.col("global_practice").isNull(), "missing").when(F.col("_p_median").isNotNull(), "exact")
    if config.overall_rung:
        rung = rung.when(able & F.col("_o_median").isNotNull(), "overall")
        practice = practice.when(F.col("_o_median").isNotNull(), "overall")
    rows = rows.withColumns({"benchmark_rung": rung.otherwise("none"), "practice_rung": practice.otherwise("none")})

    def pick(field: str):
        by = F.when(F.col("benchmark_rung") == "exact", F.col(f"_e_{field}")).when(F.col("benchmark_rung") == "category", F.col(f"_c_{field}"))
        return by.when(F.col("benchmark_rung") == "overall", F.col(f"_o_{field}"))

    rows = rows.withColumns({f"benchmark_{f}": pick(f) for f in ("median", "support_n", "sketch")})
    rows = rows.withColumn("practice_median", F.when(F.col("practice_rung") == "exact", F.col("_p_median")).when(F.col("practice_rung") == "overall", F.col("_o_median")))
    rows = rows.withColumn("benchmark_support_n", F.coalesce("benchmark_support_n", F.lit(0)).cast("long")).withColumn("benchmark_is_thin", F.col("benchmark_rung").isin("category", "overall"))
    return rows.drop("_m", *(f"{p}_{f}" for p in ("_e", "_c", "_o", "_p") for f in ("median", "support_n", "sketch")))


def engineer(cleaned: DataFrame, reference: Reference, config: EngineConfig = DEFAULT) -> DataFrame:
    """The cleaned rows with their features, benchmark columns and sketch_rank, the points of the sketch that the amount reaches."""
    # Both joins by history shuffle the rows, which are narrower without benchmarks and their sketches.
    rows = history.prior_count(reference.events, cleaned, "supplier_key", "signing_date", "supplier_prior_contract_count", config.assessment_lag_days)
    rows = history.prior_count(reference.events, rows, "project_id", "signing_date", "project_contract_sequence", config.assessment_lag_days)
    rows = benchmarks(rows, reference, config)
    rows = rows.withColumn("sketch_rank", F.when(F.col("benchmark_sketch").isNotNull() & F.col("amount_usd").isNotNull(), vintages.percentile_of("amount_usd", "benchmark_sketch")))
    return rows.withColumns(
        {
            "log_amount": F.when(F.col("amount_usd") > 0, F.log10("amount_usd")),
            "amount_vs_category_region_median": ratio("amount_usd", "benchmark_median", config),
            "amount_vs_practice_median": ratio("amount_usd", "practice_median", config),
            "amount_percentile_in_category_region": F.col("sketch_rank") / float(config.sketch_points),
            "supplier_is_known": F.col("supplier_key").isNotNull(),
            "is_first_contract_in_project": F.col("project_contract_sequence") == 0,
        }
    ).drop("benchmark_sketch")
