"""Cleaning: scalar cases, grain, and the extract's file."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from awardlens.config import COLUMNS, DEFAULT
from awardlens.functions import calendar as C
from awardlens.functions import text as X
from awardlens.operators import clean
from awardlens.sources import files, records


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("name", "expected"), [
    ("Acme Trading Co., Ltd.", "ACME TRADING"), ("ACME TRADING LIMITED", "ACME TRADING"), ("  acme   trading ", "ACME TRADING"), ("CIE SARL", "CIE"), ("CIA SARL", "CIA"),
    ("SA", "SA"), ("CO LTD", "CO LTD"), ("FOO&SA", "FOO&"), ("N/A", "N A"), ("-", None), ("Société Générale S.A.", "SOCIÉTÉ GÉNÉRALE"), ("HOTEL SPA", "HOTEL"), (None, None), (" ", None),
])
def test_supplier_name(spark, name, expected):
    assert one(spark, X.supplier_name, name) == expected


@pytest.mark.parametrize(("value", "expected"), [("1,234.5", 1234.5), ("$7", 7.0), ("1_000", 1000.0), ("1d", None), ("not a number", None), (None, None), ("-5.0", -5.0), ("1e3", 1000.0), (".5", 0.5)])
def test_amount(spark, value, expected):
    assert one(spark, X.amount, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("01/15/2021", dt.date(2021, 1, 15)), ("1/5/2021", dt.date(2021, 1, 5)), (" 01/15/2021 ", dt.date(2021, 1, 15)), ("2021-01-15", None), ("02/30/2021", None), ("13/01/2021", None), (None, None)])
def test_signing_date(spark, value, expected):
    assert one(spark, C.signing_date, value) == expected


@pytest.mark.parametrize(("day", "fy", "days", "quarter"), [(dt.date(2020, 6, 30), 2020, 365, 4), (dt.date(2020, 7, 1), 2021, 0, 1), (dt.date(2021, 6, 30), 2021, 364, 4), (dt.date(2020, 9, 30), 2021, 91, 2)])
def test_fiscal_calendar(spark, day, fy, days, quarter):
    row = spark.createDataFrame([(day,)], "d date").select(C.fiscal_year("d"), C.days_into_fiscal_year("d").alias("x"), C.quarter(C.days_into_fiscal_year("d"))).first()
    assert tuple(row) == (fy, days, quarter)


def test_method_practice_region(spark):
    kind = lambda v: one(spark, lambda c: X.method_class(c, DEFAULT), v)
    assert kind("Consultant Qualification  Selection") == kind("consultant qualification selection") == "COMPETITIVE"
    assert kind("  direct   selection ") == "NON_COMPETITIVE"
    assert kind("Vibes") is None and kind(None) is None
    rows = spark.createDataFrame([("Public Admin;Education;Health",), ("Transportation",), (None,), (";",)], "p string").select(X.primary_practice("p"), X.many_practices("p")).collect()
    assert [tuple(r) for r in rows] == [("Public Admin", True), ("Transportation", False), (None, False), (None, False)]
    rows = spark.createDataFrame([("DRC - Angola", None), ("Kenya", "KE"), (None, None)], "n string, c string").select(X.is_regional("n", "c")).collect()
    assert [r[0] for r in rows] == [True, False, False]
    assert one(spark, X.country_code, " ke ") == "KE"


def test_composed_characters(spark):
    df = X.compose(spark.createDataFrame([("ＡＣＭＥ Ltd", 1), ("plain", 2), (None, 3)], "s string, k int"), "s")
    assert {r["k"]: r["s"] for r in df.collect()} == {1: "ACME Ltd", 2: "plain", 3: None}


def raw(spark, *rows):
    base = {"region": "South Asia", "borrower_country": "India", "borrower_country_code": "IN", "project_id": "P0001", "global_practice_raw": "Transportation", "procurement_category": "Goods", "procurement_method_raw": "Request for Bids", "contract_id": 1, "signing_date_raw": "01/15/2021", "supplier_id": "S1", "supplier_name_raw": "ACME TRADING CO LTD", "supplier_country": "India", "supplier_country_code": "IN", "amount_usd": 100000.0, "review_type": "Prior", "fiscal_year_published": "2021"}
    return spark.createDataFrame([tuple((base | r).get(f.name) for f in files.RAW) for r in rows], files.RAW)


def test_grain_does_not_depend_on_order(spark):
    rows = [{"contract_id": 1, "supplier_name_raw": "B", "supplier_id": "S2"}, {"contract_id": 1, "supplier_name_raw": "A", "supplier_id": "S9"}, {"contract_id": 1, "supplier_name_raw": "A", "supplier_id": None}, {"contract_id": 2, "supplier_name_raw": None}]
    seen = []
    for order in (rows, rows[::-1]):
        cleaned = clean.clean(raw(spark, *order))
        seen.append(sorted((r["contract_id"], r["supplier_name"], r["supplier_id"], r["consortium_size"]) for r in clean.contract_grain(cleaned).collect()))
    assert seen[0] == seen[1] == [(1, "A", "S9", 3), (2, None, "S1", 1)]


def test_tri_state(spark):
    rows = clean.clean(raw(spark, {}, {"supplier_country_code": "KE"}, {"supplier_country_code": None, "supplier_country": None}, {"borrower_country": "World", "borrower_country_code": None}, {"supplier_country": "Panama"})).orderBy("consortium_size").collect()
    assert {(r["supplier_is_domestic"], r["supplier_in_secrecy_jurisdiction"]) for r in rows} == {(True, False), (False, False), (None, None), (None, False), (True, True)}


def test_csv(spark, tmp_path):
    path = tmp_path / "extract.csv"
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(path))
    header = ",".join(f'"{c}"' for c in COLUMNS)
    values = {"WB Contract Number": "7", "Supplier Contract Amount (USD)": "12.5", "Contract Description": '"two\nlines, and ""quotes"""', "Borrower Country / Economy Code": "NA"}
    path.write_text(header + "\n" + ",".join(values.get(c, "") for c in COLUMNS) + "\n")
    row = files.read_csv(spark, str(path)).first()
    assert (row["contract_id"], row["amount_usd"], row["contract_description"], row["borrower_country_code"], row["region"]) == (7, 12.5, 'two\nlines, and "quotes"', "NA", None)
    assert files.read_csv(spark, str(path), na_tokens=("NA",)).first()["borrower_country_code"] is None
    cache = str(tmp_path / "cache")
    assert files.load(spark, str(path), cache).count() == 1
    assert files.load(spark, str(path), cache).count() == 1
    path.write_text(header + "\n")
    assert files.load(spark, str(path), cache).count() == 0
    path.write_text(header + ',"More"\n')
    with pytest.raises(ValueError, match="More"):
        files.read_csv(spark, str(path))


def test_record_aliases(spark):
    assert records.value({"Region": "X", "region": None}, "region") == "X"
    assert records.value({"Region": None, "region": "X"}, "region") is None
    assert records.value({"region": "X"}, "region") == "X"
    assert records.value({"Region": " "}, "region") is None
    row = records.from_records(spark, [{"Supplier Contract Amount (USD)": 5.5, "WB Contract Number": 3}]).first()
    assert (row["row_id"], row["amount_usd"], row["contract_id"], row["consortium_size"]) == (0, "5.5", 3, None)
