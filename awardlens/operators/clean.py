"""Cleaning: the raw columns stay, derived ones are added; the two grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import calendar as C
from ..functions import text as X

_TEXTS = ("region", "borrower_country", "supplier_country", "project_id", "procurement_category", "review_type", "supplier_id")
#: Whether a row is the one that its contract has at contract grain.
FIRST = "_first"
_CODES = ("borrower_country_code", "supplier_country_code")


def normalise(df: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """All derived columns of a row by itself. signing_date_raw keeps its text; amount_usd is a number."""
    df = X.compose(df, *_TEXTS, *_CODES, "supplier_name_raw", "global_practice_raw", "procurement_method_raw", "signing_date_raw")
    df = df.withColumns({n: X.text(n) for n in _TEXTS} | {n: X.country_code(n) for n in _CODES} | {"amount_usd": X.known_number("amount_usd")} | {"supplier_name": X.supplier_name("supplier_name_raw"), "signing_date": C.signing_date("signing_date_raw"), "method_class": X.method_class("procurement_method_raw", config)})
    df = df.withColumns(
        {
            "supplier_is_placeholder": X.is_placeholder("supplier_name"),
            "supplier_key": X.supplier_key("supplier_name"),
            "global_practice": X.primary_practice("global_practice_raw"),
            "global_practice_multi": X.many_practices("global_practice_raw"),
            "borrower_is_regional": X.is_regional("borrower_country", "borrower_country_code"),
            "fiscal_year": C.fiscal_year("signing_date"),
            "is_competitive_method": X.is_competitive("method_class"),
            "supplier_in_secrecy_jurisdiction": X.in_secrecy("supplier_country", config),
        }
    )
    df = df.withColumns({"fiscal_year_start": C.fiscal_year_start("fiscal_year"), "days_into_fiscal_year": C.days_into_fiscal_year("signing_date"), "supplier_is_domestic": X.is_domestic("borrower_is_regional", *_CODES)})
    return df.withColumn("fy_quarter", C.quarter("days_into_fiscal_year"))


def clean(raw: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """normalise, and how many rows a contract has. A null contract number is a contract of its own."""
    rows = F.count("*").over(Window.partitionBy("contract_id"))
    df = normalise(raw, config).withColumn("consortium_size", rows.cast("int"))
    return df.withColumn("is_consortium_member", F.col("consortium_size") > 1)


def marked(cleaned: DataFrame) -> DataFrame:
    """The rows with FIRST, true in one row a contract: the first by supplier name, then supplier id, nulls last; of rows alike in both, by a hash of the row.

    The window is that of consortium_size, so the rows are shuffled once for both.
    """
    alike = F.xxhash64(*(c for c, t in cleaned.dtypes if not t.startswith("map")))
    order = Window.partitionBy("contract_id").orderBy(F.asc_nulls_last("supplier_name"), F.asc_nulls_last("supplier_id"), alike)
    return cleaned.withColumn(FIRST, F.row_number().over(order) == 1)


def contract_grain(cleaned: DataFrame) -> DataFrame:
    """One row a contract, the one that marked() marks; rows that are marked already are only filtered."""
    return (cleaned if FIRST in cleaned.columns else marked(cleaned)).filter(FIRST).drop(FIRST)


def usable(grain: DataFrame) -> DataFrame:
    """Contracts that statistics are made of; a contract whose first row has no amount or date isn't."""
    return grain.filter("amount_usd > 0 and signing_date is not null")
