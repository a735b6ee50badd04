"""The engine's queries against their SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import pytest

from awardlens import queries
from awardlens.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x if x is None or isinstance(x, (int, str)) else float(x) if type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", ["contract_grain", "cleaned_rows", "vintage_category_region", "feature_table", "quality_register", "rule_outcomes", "rule_calibration", "fiscal_year_coverage", "threshold_table", "evaluate", "audit_records"])
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    expected = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == expected


def test_every_query_has_sql_or_needs_none():
    assert set(QUERIES) - set(ORACLE_SQL) == {"lr_scores", "gbt_scores", "anomaly_flags", "classify_contracts"}


def test_vintages_of_amounts_with_more_decimals(spark, monkeypatch, tmp_path):
    """Amounts whose quantiles lie halfway between fourth decimals: the SQL's steps of interpolation and rounding decide."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    rows = [(rng.choice("ABC"), rng.randrange(100_000_000) / 1000 * 1.001**k, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(900))) for _ in range(1000) for k in range(6)]
    contracts = spark.createDataFrame(rows, "procurement_category string, amount_usd double, signing_date date").filter("amount_usd > 0")
    contracts.write.parquet(f"{tmp_path}/usable")
    monkeypatch.setattr(queries, "_usable", lambda *_: contracts)
    got = sorted(tuple(r) for r in QUERIES["vintage_category"](spark, "").collect())
    usable = f"usable AS (SELECT *, year(signing_date) * 12 + month(signing_date) - 1 AS m FROM read_parquet('{tmp_path}/usable/*.parquet'))"
    ending = ORACLE_SQL["vintage_category"].rpartition("usable AS MATERIALIZED (SELECT * FROM grain WHERE amount_usd > 0)")[2]
    expected = sorted(duckdb.connect().execute(f"WITH {usable}{ending}").fetchall())
    assert len(got) > 60
    assert got == expected


@pytest.mark.parametrize("name", ["contract_grain", "vintage_category"])
def test_lines_without_part_or_supplier(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    some = {"part": " WHERE hash(p_partkey) % 10 >= 4", "supplier": " WHERE hash(s_suppkey) % 10 >= 3"}
    for t in TABLES:
        db.execute(f"copy (select * from read_parquet('{SF}/{t}.parquet'){some.get(t, '')}) to '{tmp_path}/{t}.parquet' (format parquet)")
        db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    expected = sorted(([plain(x) for x in r] for r in cursor.fetchall()), key=repr)
    assert len(expected) > 50
    assert sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["vintage_category", "vintage_category_region", "vintage_trend"])
def test_vintages_of_unknown_groups_and_days(spark, tmp_path, name):
    """Contracts without a category, without a date, or with an amount beyond all."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    odd = {"customer": " REPLACE (CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment)", "orders": " REPLACE (CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 400 = 5 THEN 'inf'::DOUBLE ELSE o_totalprice END AS o_totalprice)"}
    for t in TABLES:
        db.execute(f"copy (select *{odd.get(t, '')} from read_parquet('{SF}/{t}.parquet')) to '{tmp_path}/{t}.parquet' (format parquet)")
        db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    expected = sorted(([plain(x) for x in r] for r in cursor.fetchall()), key=repr)
    assert any(r[0] is None for r in expected) and any(None in r[1:] for r in expected) or name == "vintage_trend"
    assert sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr) == expected
