"""Validation: the 24 flags of a record, whether it is fit for assessment, and what is known of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as X
from . import clean, features
from .reference import Reference

FATAL, DEGRADED, NOTICE = "FATAL", "DEGRADED", "NOTICE"
# Flags and their severity; the meaning is in our words.
FLAGS = {
    "SUPPLIER_MISSING": (FATAL, "There is no supplier's name."),
    "BORROWER_COUNTRY_MISSING": (FATAL, "There is no borrower country."),
    "PROCUREMENT_CATEGORY_MISSING": (FATAL, "There is no category, so no peer group."),
    "AMOUNT_MISSING": (FATAL, "There is no amount."),
    "AMOUNT_NON_POSITIVE": (FATAL, "The amount is zero or less."),
    "AMOUNT_UNPARSEABLE": (FATAL, "The amount isn't a number."),
    "SIGNING_DATE_MISSING": (FATAL, "There is no signing date."),
    "SIGNING_DATE_UNPARSEABLE": (FATAL, "The signing date isn't month/day/year."),
    "PROCUREMENT_METHOD_MISSING": (FATAL, "There is no procurement method."),
    "PROCUREMENT_METHOD_UNMAPPED": (FATAL, "The procurement method isn't a known one."),
    "SUPPLIER_UNIDENTIFIABLE": (DEGRADED, "The supplier's name stands for no one in particular; its history is unknown."),
    "SUPPLIER_COUNTRY_MISSING": (DEGRADED, "The supplier has no country code, so it can't be told to be domestic."),
    "BORROWER_IS_REGIONAL": (DEGRADED, "The borrower is no single country, so no supplier is domestic or foreign."),
    "GLOBAL_PRACTICE_MISSING": (DEGRADED, "There is no practice to compare with."),
    "THIN_REFERENCE_GROUP": (DEGRADED, "The peer group was too small; a wider one was used."),
    "REFERENCE_MEDIAN_UNAVAILABLE": (DEGRADED, "There is no benchmark for the record."),
    "PROJECT_HISTORY_UNAVAILABLE": (DEGRADED, "There is no project, so no place in its history."),
    "FISCAL_YEAR_DISAGREEMENT": (NOTICE, "The published fiscal year isn't the signing date's."),
    "SIGNING_DATE_OUTSIDE_FY_WINDOW": (NOTICE, "The signing date is outside its fiscal year."),
    "SIGNING_DATE_AFTER_EXTRACT": (NOTICE, "The signing date is later than the extract."),
    "CONSORTIUM_MEMBER_ROW": (NOTICE, "The contract has more than one supplier."),
    "CONSORTIUM_SIZE_UNKNOWN": (DEGRADED, "The number of the contract's suppliers isn't given."),
    "MULTI_PRACTICE_PROJECT": (NOTICE, "The project has several practices; the first is used."),
    "REVIEW_TYPE_MISSING": (NOTICE, "There is no type of review."),
}
_RANK = {FATAL: 0, DEGRADED: 1, NOTICE: 2}


def with_severity(flags: Column | str, severity: str) -> Column:
    names = F.array(*(F.lit(n) for n, (s, _) in FLAGS.items() if s == severity))
    return F.array_intersect(flags, names)


def is_fatal(flags: Column | str) -> Column:
    return F.size(with_severity(flags, FATAL)) > 0


def describe(flag: str) -> str:
    return FLAGS[flag][1]


def dimension(spark: SparkSession) -> DataFrame:
    """flag, severity, rank and meaning."""
    return spark.createDataFrame([(n, s, _RANK[s], m) for n, (s, m) in FLAGS.items()], "flag string, severity string, severity_rank int, meaning string")


def required(rows: DataFrame, amount_text: str | None = None) -> Column:
    """The flags of the required fields. amount_text: a column with the amount as it came, to tell unreadable from missing."""
    amount = F.col("amount_usd")
    came = F.col(amount_text) if amount_text else amount.cast("string")
    lost = amount.isNull() & X.known(came).isNotNull() & ~F.lower(F.trim(F.regexp_replace(came, "[,$]", ""))).isin("nan", "+nan", "-nan")
    method, date = X.known("procurement_method_raw"), X.known("signing_date_raw")
    return F.array_compact(
        F.array(
            F.when(F.col("supplier_name").isNull(), "SUPPLIER_MISSING").when(F.col("supplier_is_placeholder"), "SUPPLIER_UNIDENTIFIABLE"),
            F.when(F.col("borrower_country").isNull(), "BORROWER_COUNTRY_MISSING"),
            F.when(F.col("procurement_category").isNull(), "PROCUREMENT_CATEGORY_MISSING"),
            F.when(lost, "AMOUNT_UNPARSEABLE").when(amount.isNull(), "AMOUNT_MISSING").when(amount <= 0, "AMOUNT_NON_POSITIVE"),
            F.when(date.isNull(), "SIGNING_DATE_MISSING").when(F.col("signing_date").isNull(), "SIGNING_DATE_UNPARSEABLE"),
            F.when(method.isNull(), "PROCUREMENT_METHOD_MISSING").when(F.col("method_class").isNull(), "PROCUREMENT_METHOD_UNMAPPED"),
        )
    )


def validate(enriched: DataFrame, config: EngineConfig = DEFAULT, amount_text: str | None = None) -> DataFrame:
    """The engineered rows with data_quality_flags, ok, and the structs features and normalized.

    A record with a fatal flag has no features and the flags of its required fields alone.
    """
    days = F.col("days_into_fiscal_year")
    later = F.array_compact(
        F.array(
            F.when(F.col("fiscal_year_published").try_cast("int") != F.col("fiscal_year"), "FISCAL_YEAR_DISAGREEMENT"),
            F.when(~days.between(0, 366), "SIGNING_DATE_OUTSIDE_FY_WINDOW"),
            F.when(F.col("signing_date") > F.lit(config.data_as_of).cast("date"), "SIGNING_DATE_AFTER_EXTRACT"),
            F.when(F.col("borrower_is_regional"), "BORROWER_IS_REGIONAL"),
            F.when(F.col("supplier_country_code").isNull(), "SUPPLIER_COUNTRY_MISSING"),
            F.when(F.col("benchmark_is_thin") | (F.col("practice_rung") == "overall"), "THIN_REFERENCE_GROUP"),
            F.when((F.col("benchmark_rung") == "none") | (F.col("practice_rung") == "none"), "REFERENCE_MEDIAN_UNAVAILABLE"),
            F.when(F.col("global_practice_multi"), "MULTI_PRACTICE_PROJECT"),
            F.when(F.col("global_practice").isNull(), "GLOBAL_PRACTICE_MISSING"),
            F.when(F.col("project_id").isNull(), "PROJECT_HISTORY_UNAVAILABLE"),
            F.when(F.col("review_type").isNull(), "REVIEW_TYPE_MISSING"),
            F.when(F.col("consortium_size").isNull(), "CONSORTIUM_SIZE_UNKNOWN").when(F.col("consortium_size") > 1, "CONSORTIUM_MEMBER_ROW"),
        )
    )
    first = required(enriched, amount_text)
    rows = enriched.withColumn("_first", first).withColumn("ok", ~is_fatal("_first"))
    rows = rows.withColumn("data_quality_flags", F.array_sort(F.array_distinct(F.when(F.col("ok"), F.concat("_first", later)).otherwise(F.col("_first")))))
    known = F.col("ok") & F.col("benchmark_median").isNotNull()
    always = ["supplier_key", "supplier_name_raw", "borrower_country", "procurement_category", "amount_usd", "signing_date", "procurement_method", "method_class", "region"]
    values = {
        "procurement_method": X.text("procurement_method_raw"),
        "supplier_name_raw": X.text("supplier_name_raw"),
        "signing_date": F.date_format("signing_date", "yyyy-MM-dd"),
        "reference_version": F.lit(config.version),
        "benchmark_vintage_month": F.when(known, F.date_format("signing_date", "yyyy-MM")),
    }
    if_ok = ["fiscal_year", "global_practice", "project_id", "review_type", "benchmark_median", "practice_median", "reference_version", "benchmark_vintage_month"]
    normalized = F.struct(*(values.get(n, F.col(n)).alias(n) for n in always), *(F.when(F.col("ok"), values.get(n, F.col(n))).alias(n) for n in if_ok))
    rows = rows.withColumn("normalized", normalized).withColumn("features", F.when(F.col("ok"), F.struct(*features.FEATURES)))
    return rows.drop("_first")


def enrich(records: DataFrame, reference: Reference, config: EngineConfig = DEFAULT) -> DataFrame:
    """Raw records, with amounts as texts and consortium_size as given, to validated rows: the same plan as a batch's."""
    rows = records.withColumn("_amount_text", F.col("amount_usd").cast("string")).withColumn("amount_usd", X.amount("amount_usd"))
    rows = clean.normalise(rows, config)
    return validate(features.engineer(rows, reference, config), config, "_amount_text").drop("_amount_text")


def validate_batch(cleaned: DataFrame, reference: Reference, config: EngineConfig = DEFAULT) -> DataFrame:
    return validate(features.engineer(cleaned, reference, config), config)
