"""Benchmarks, history, flags, rules, model, detector and cohorts on small tables."""

from __future__ import annotations

import datetime as dt
import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from awardlens.config import DEFAULT, EngineConfig
from awardlens.operators import anomaly, clean, cohort, features, flags, history, metrics, model, reference, rules, vintages
from awardlens.plans import engine, reports
from awardlens.sources import records
from tests.test_cleaning import raw

AT = dt.datetime(2026, 8, 23, 12, tzinfo=dt.UTC)


def awards(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        day = dt.date(2020, 7, 1) + dt.timedelta(days=rng.randrange(300))
        rows.append({"contract_id": 100 + k - k % 7 // 6, "signing_date_raw": day.strftime("%m/%d/%Y"), "amount_usd": float(rng.choice([0, 5, 1000 * rng.randrange(1, 90)])), "supplier_name_raw": f"SUPPLIER {rng.randrange(9)}", "supplier_id": f"S{k}", "project_id": f"P{rng.randrange(5)}", "region": rng.choice(["South Asia", "Africa", None]), "procurement_category": rng.choice(["Goods", "Works"]), "global_practice_raw": rng.choice(["Water", "Health;Water", None]), "procurement_method_raw": rng.choice(["Request for Bids", "Direct Selection"])})
    return raw(spark, *rows)


def test_vintages_by_brute_force(spark):
    contracts = clean.usable(clean.contract_grain(clean.clean(awards(spark, 300))))
    rows = [(r["procurement_category"], r["region"], r["signing_date"], r["amount_usd"]) for r in contracts.collect()]
    for keys, pick in ((("procurement_category",), lambda r: (r[0],)), (("procurement_category", "region"), lambda r: (r[0], r[1])), ((), lambda r: ())):
        got = {tuple(r[k] for k in (*keys, "m")): r for r in vintages.build(contracts, keys).collect()}
        expected = {}
        for r in rows:
            m = r[2].year * 12 + r[2].month - 1
            before = [x[3] for x in rows if pick(x) == pick(r) and x[2].year * 12 + x[2].month - 1 < m]
            if None not in pick(r) and len(before) >= 30:
                expected[(*pick(r), m)] = before
        assert got.keys() == expected.keys() and got
        for key, before in expected.items():
            assert got[key]["support_n"] == len(before)
            assert np.allclose(got[key]["sketch"], np.quantile(before, np.arange(101) / 100), rtol=1e-12)
            assert got[key]["median"] == pytest.approx(np.median(before))


def test_vintage_sketches_are_close(spark):
    contracts = clean.usable(clean.contract_grain(clean.clean(awards(spark, 300))))
    exact = {r["m"]: r for r in vintages.build(contracts, ()).collect()}
    near = {r["m"]: r for r in vintages.build(contracts, (), approximate=True).collect()}
    assert exact.keys() == near.keys()
    for m, r in near.items():
        assert r["support_n"] == exact[m]["support_n"]
        assert abs(r["median"] - exact[m]["median"]) <= 0.06 * 90_000


def test_prior_count(spark):
    d = dt.date
    events = spark.createDataFrame([("A", d(2021, 1, 1)), ("A", d(2021, 6, 1)), ("A", d(2021, 6, 1)), ("B", d(2021, 3, 1)), ("A", None), (None, d(2020, 1, 1))], "k string, d date")
    asked = spark.createDataFrame([(0, "A", d(2020, 12, 31)), (1, "A", d(2021, 6, 1)), (2, "A", d(2021, 6, 2)), (3, "B", d(2022, 1, 1)), (4, None, d(2021, 1, 1)), (5, "A", None), (6, "Z", d(2021, 1, 1)), (7, "A", d(2021, 6, 2))], "i int, k string, d date")
    got = {r["i"]: r["n"] for r in history.prior_count(events, asked, "k", "d", "n").collect()}
    assert got == {0: 0, 1: 1, 2: 3, 3: 1, 4: None, 5: None, 6: 0, 7: 3}
    assert {r[0]: r[1] for r in history.earliest(events, "k", "d").collect()} == {"A": d(2021, 1, 1), "B": d(2021, 3, 1)}
    assert history.distinct_keys(events, "k", "d").first()[0] == 2


def rung_rows(spark):
    # 35 contracts of one category in January, then one of each kind in February.
    rows = [{"contract_id": k, "signing_date_raw": "01/10/2021", "amount_usd": 1000.0 * (k + 1), "region": "R" if k < 31 else "Q", "global_practice_raw": "Water"} for k in range(35)]
    late = [("R", "Goods"), ("Q", "Goods"), (None, "Goods"), ("R", "Works")]
    return rows + [{"contract_id": 90 + k, "signing_date_raw": "02/10/2021", "amount_usd": 20_000.0, "region": r, "procurement_category": c, "global_practice_raw": p} for k, ((r, c), p) in enumerate(zip(late, ("Water", "Health", None, "Water"), strict=True))]


def test_ladder(spark):
    cleaned = clean.clean(raw(spark, *rung_rows(spark)))
    for config, last in ((DEFAULT, "overall"), (EngineConfig(overall_rung=False), "none")):
        rows = features.engineer(cleaned, reference.plan(cleaned, config), config).filter("contract_id >= 90").orderBy("contract_id").collect()
        assert [r["benchmark_rung"] for r in rows] == ["exact", "category", "category", last]
        assert [r["practice_rung"] for r in rows] == ["exact", last, "missing", "exact"]
        assert [r["benchmark_support_n"] for r in rows] == [31, 35, 35, 35 if last == "overall" else 0]
        assert rows[0]["benchmark_median"] == 16_000 and rows[0]["amount_vs_category_region_median"] == pytest.approx(1.25)
        assert rows[0]["sketch_rank"] == sum(q <= 20_000 for q in np.quantile(np.arange(1, 32) * 1000.0, np.arange(101) / 100))
    # March has no contract in the group: no cell in its month, but one as of it.
    march = clean.clean(raw(spark, *rung_rows(spark), {"contract_id": 99, "signing_date_raw": "03/10/2021", "procurement_category": "Goods", "region": "R"})).filter("contract_id = 99")
    made = reference.plan(cleaned)
    assert features.engineer(march, made).first()["benchmark_rung"] == "none"
    assert features.engineer(march, made, EngineConfig(lookup="asof")).first()["benchmark_rung"] == "exact"


@pytest.mark.parametrize(("change", "flag"), [
    ({"amount_usd": "0.0"}, "AMOUNT_NON_POSITIVE"), ({"amount_usd": "-5.0"}, "AMOUNT_NON_POSITIVE"), ({"amount_usd": None}, "AMOUNT_MISSING"), ({"amount_usd": "not a number"}, "AMOUNT_UNPARSEABLE"), ({"amount_usd": "nan"}, "AMOUNT_MISSING"),
    ({"supplier_name_raw": None}, "SUPPLIER_MISSING"), ({"Borrower Country / Economy": " "}, "BORROWER_COUNTRY_MISSING"), ({"procurement_category": None}, "PROCUREMENT_CATEGORY_MISSING"), ({"signing_date_raw": None}, "SIGNING_DATE_MISSING"),
    ({"signing_date_raw": "2021-01-15"}, "SIGNING_DATE_UNPARSEABLE"), ({"procurement_method_raw": None}, "PROCUREMENT_METHOD_MISSING"), ({"procurement_method_raw": "Vibes"}, "PROCUREMENT_METHOD_UNMAPPED"),
])
def test_fatal(spark, made, change, flag):
    row = flags.enrich(records.from_records(spark, [BASE | change]), made).first()
    assert not row["ok"] and row["features"] is None and row["data_quality_flags"] == [flag]


BASE = {"Region": "R", "Borrower Country / Economy": "India", "Borrower Country / Economy Code": "IN", "Project ID": "P0001", "Project Global Practice": "Water", "procurement_category": "Goods", "procurement_method_raw": "Request for Bids", "contract_id": 1, "signing_date_raw": "02/15/2021", "supplier_name_raw": "ACME TRADING CO LTD", "supplier_country": "India", "supplier_country_code": "IN", "amount_usd": "100000.0", "review_type": "Prior", "fiscal_year_published": "2021"}


@pytest.fixture(scope="module")
def made(spark):
    return reference.fit(clean.clean(raw(spark, *rung_rows(spark))))


def test_flags_of_a_good_record(spark, made):
    def of(**change):
        return flags.enrich(records.from_records(spark, [BASE | change]), made).first()

    row = of()
    assert row["ok"] and row["data_quality_flags"] == ["CONSORTIUM_SIZE_UNKNOWN"]
    assert row["features"]["benchmark_support_n"] == 31 and row["normalized"]["benchmark_vintage_month"] == "2021-02"
    assert of(consortium_size=3)["data_quality_flags"] == ["CONSORTIUM_MEMBER_ROW"]
    odd = of(consortium_size=1, supplier_name_raw="Individual Consultant", supplier_country_code=None, review_type=None, fiscal_year_published="2020", signing_date_raw="02/10/2030", **{"Project ID": None, "Project Global Practice": None})
    assert odd["data_quality_flags"] == ["FISCAL_YEAR_DISAGREEMENT", "GLOBAL_PRACTICE_MISSING", "PROJECT_HISTORY_UNAVAILABLE", "REFERENCE_MEDIAN_UNAVAILABLE", "REVIEW_TYPE_MISSING", "SIGNING_DATE_AFTER_EXTRACT", "SUPPLIER_COUNTRY_MISSING", "SUPPLIER_UNIDENTIFIABLE"]
    assert odd["supplier_prior_contract_count"] is None and odd["is_first_contract_in_project"] is None
    assert len(flags.FLAGS) == 24 and all(m for _, m in flags.FLAGS.values())


def test_reference_is_saved(spark, made, tmp_path):
    made.save(str(tmp_path))
    again = reference.load(spark, str(tmp_path))
    assert again.version == made.version and again.months == made.months
    one = flags.enrich(records.from_records(spark, [BASE]), again).first()
    assert one["features"]["benchmark_support_n"] == 31
    with pytest.raises(ValueError, match="no usable"):
        reference.fit(clean.clean(raw(spark, {"amount_usd": 0.0})))


RULE = {"amount_usd": 50_000.0, "amount_percentile_in_category_region": 0.5, "amount_vs_category_region_median": 1.0, "is_competitive_method": True, "is_first_contract_in_project": False, "supplier_in_secrecy_jurisdiction": False, "supplier_is_domestic": True, "days_into_fiscal_year": 100}
TYPES = "amount_usd double, amount_percentile_in_category_region double, amount_vs_category_region_median double, is_competitive_method boolean, is_first_contract_in_project boolean, supplier_in_secrecy_jurisdiction boolean, supplier_is_domestic boolean, days_into_fiscal_year int, ok boolean, data_quality_flags array<string>"


def decide(spark, config=DEFAULT, **change):
    row = RULE | {"ok": True, "data_quality_flags": []} | change
    return rules.apply(spark.createDataFrame([tuple(row.values())], TYPES), config).first()


@pytest.mark.parametrize(("change", "rank", "reasons"), [
    ({}, None, []),
    ({"amount_vs_category_region_median": 500.0}, 1, ["AMOUNT_EXTREME_FOR_PEER_GROUP"]),
    ({"is_competitive_method": False, "amount_usd": 5e6}, 1, ["NON_COMPETITIVE_HIGH_VALUE"]),
    ({"supplier_in_secrecy_jurisdiction": True, "supplier_is_domestic": False}, 1, ["OFFSHORE_SUPPLIER_FOREIGN_TO_BORROWER"]),
    ({"is_first_contract_in_project": True, "amount_vs_category_region_median": 50.0}, 1, ["FIRST_CONTRACT_IN_PROJECT_HIGH_VALUE"]),
    ({"is_competitive_method": False, "amount_usd": 1000.0}, None, []),
    ({"supplier_in_secrecy_jurisdiction": True}, None, []),
    ({"supplier_is_domestic": None}, None, []),
    ({"amount_vs_category_region_median": None}, 2, ["UNEVALUABLE::AMOUNT_EXTREME_FOR_PEER_GROUP"]),
    ({"is_competitive_method": False, "amount_usd": 5e6, "amount_vs_category_region_median": None}, 1, ["NON_COMPETITIVE_HIGH_VALUE"]),
    ({"ok": False, "data_quality_flags": ["AMOUNT_MISSING", "SUPPLIER_UNIDENTIFIABLE"]}, 0, ["AMOUNT_MISSING"]),
])
def test_rules(spark, change, rank, reasons):
    row = decide(spark, **change)
    assert (row["cohort_rank"], row["rule_reasons"]) == (rank, reasons)


def test_rules_read_settings_when_built(spark):
    assert decide(spark, EngineConfig(amount_multiple=5.0), amount_vs_category_region_median=50.0)["cohort_rank"] == 1
    assert rules.catalogue(spark).count() == 5


def test_three_valued_and(spark):
    values = [True, False, None]
    rows = spark.createDataFrame(list(itertools.product(values, values)), "a boolean, b boolean")
    for a, b, got in rows.select("a", "b", (F.col("a") & F.col("b")).alias("x")).collect():
        assert got == (False if a is False or b is False else None if a is None or b is None else True)


def scored(spark, n=5000, seed=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.05).astype(int)
    s = np.clip(0.3 * y + 0.5 * rng.random(n), 0, 1)
    return spark.createDataFrame([(int(k), int(a), float(b)) for k, (a, b) in enumerate(zip(y, s, strict=True))], "id long, y int, p double"), y, s


def test_metrics(spark):
    rows, y, s = scored(spark)
    table = metrics.threshold_table(rows).orderBy("flag_rate_target").collect()
    assert len(table) == 14 and all(a["threshold"] >= b["threshold"] and a["recall"] <= b["recall"] for a, b in itertools.pairwise(table))
    assert table[3]["threshold"] == pytest.approx(round(np.quantile(s, 0.99), 6))
    chosen = metrics.choose_threshold(metrics.threshold_table(rows)).first()[0]
    assert ((s >= chosen) & (y == 1)).sum() / y.sum() >= 0.89
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert metrics.auc(rows).first()[0] == pytest.approx(auc)
    assert metrics.auc(rows.filter("y = 0")).first()[0] is None
    top = np.argsort(-s)[:500]
    assert metrics.precision_at_top_decile(rows, "id").first()[0] == pytest.approx(y[top].mean())
    tied = spark.createDataFrame([(k, int(k < 3), 0.5) for k in range(30)], "id long, y int, p double")
    assert metrics.precision_at_top_decile(tied, "id").first()[0] == 1.0
    bins = metrics.calibration(spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.1000001), (1, 1.0)], "y int, p double")).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(1, 2), (2, 1), (10, 1)]
    label = spark.createDataFrame([(0.99, False), (0.99, True), (0.1, False), (0.1, True), (None, False)], "amount_percentile_in_category_region double, is_competitive_method boolean")
    assert [r[0] for r in label.select(metrics.target()).collect()] == [1, 0, 0, 0, 0]
    assert metrics.share_flagged_in_target(rows, 2.0).first()[0] is None


def eligible_rows(spark, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        size, competitive = float(rng.random()), bool(rng.random() < 0.7)
        prior = None if rng.random() < 0.2 else int(30 * size * rng.random())
        out.append((k, 2020 + k % 7, size, competitive, 1 + 3 * size, 1000 + 1e5 * size, 3 + size, prior, int(rng.integers(9)), int(rng.integers(365)), int(rng.integers(1, 5)), 1 + int(size > 0.9), int(rng.integers(30, 99)), bool(size > 0.5), bool(rng.random() < 0.2), False, rng.choice(["R", "Q"]), rng.choice(["Goods", "Works"]), rng.choice(["Prior", "Post"]), 1.0))
    names = "id long, fiscal_year int, amount_percentile_in_category_region double, is_competitive_method boolean, amount_vs_category_region_median double, amount_usd double, log_amount double, supplier_prior_contract_count long, project_contract_sequence long, days_into_fiscal_year int, fy_quarter int, consortium_size int, benchmark_support_n long, supplier_is_domestic boolean, is_first_contract_in_project boolean, supplier_in_secrecy_jurisdiction boolean, region string, procurement_category string, review_type string, amount_vs_practice_median double"
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else str(x) if isinstance(x, np.str_) else x for x in r) for r in out], names)


def test_model(spark):
    parts = metrics.split(eligible_rows(spark))
    assert not set(model.feature_columns()) & set(model.LABEL_DEFINING)
    test = parts["test"]
    for kind, options in (("logistic", {}), ("gbt", {"max_iter": 5})):
        leaky = model.train(parts["train"], parts["validate"], kind, include_label_defining=True, **options)
        fitted = model.train(parts["train"], parts["validate"], kind, **options)
        area = [metrics.auc(m.transform(test).select(F.col("risk_score").alias("p"), metrics.target().alias("y"))).first()[0] for m in (leaky, fitted)]
        assert area[0] > 0.9 and area[0] > area[1] > 0.5
        explained = fitted.explain(fitted.transform(test.limit(20))).collect()
        assert all(0 <= r["risk_score"] <= 1 and r["risk_band"] in metrics.BANDS and len(r["top_contributing_features"]) == 3 for r in explained)
        sizes = [[abs(x["contribution"]) for x in r["top_contributing_features"]] for r in explained]
        assert all(s == sorted(s, reverse=True) for s in sizes)
        with pytest.raises(ValueError, match="region"):
            fitted.transform(test.drop("region"))
    with pytest.raises(ValueError, match="kind"):
        model.train(parts["train"], parts["validate"], "other")


def test_rows_alike_are_trained_on_once(spark, monkeypatch):
    """Trees get each row once, weighted by its number, and their nodes count all rows."""
    parts, seen, fit = metrics.split(eligible_rows(spark, 300)), [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, rows: seen.append(rows.agg(F.count("*"), F.sum("w")).first()) or fit(self, rows))
    thrice = parts["train"].crossJoin(spark.range(3).select(F.col("id").alias("copy")))
    fitted = model.train(thrice, parts["validate"], max_iter=2)
    n = parts["train"].count()
    assert tuple(seen[0]) == (n, 3 * n)
    assert all(t.weight[0] == 3 * n for t in model._export(spark, fitted.trees))


def test_contributions_add_up(spark):
    parts = metrics.split(eligible_rows(spark))
    for kind, options in (("logistic", {}), ("gbt", {"max_iter": 3})):
        fitted = model.train(parts["train"], parts["validate"], kind, **options)
        rows = fitted.contributions(fitted.with_margin(parts["test"].limit(30))).select("margin", F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["contribution"]).alias("s")).collect()
        rest = {round(r["margin"] - r["s"], 6) for r in rows}
        assert len(rest) == 1


def test_tree_shap_by_brute_force():
    """Against the sum over all coalitions, for a tree by hand and random ones that split on a feature more than once."""
    from itertools import combinations
    from math import factorial

    def value(tree, x, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if f in known:
            return value(tree, x, known, a if x[f] <= tree.threshold[node] else b)
        return (tree.weight[a] * value(tree, x, known, a) + tree.weight[b] * value(tree, x, known, b)) / tree.weight[node]

    def expected(trees, x):
        out = np.zeros(len(x))
        for j in range(len(x)):
            others = [i for i in range(len(x)) if i != j]
            for size in range(len(x)):
                w = factorial(size) * factorial(len(x) - size - 1) / factorial(len(x))
                for s in combinations(others, size):
                    out[j] += w * sum(value(t, x, {*s, j}) - value(t, x, set(s)) for t in trees)
        return out

    rng = np.random.default_rng(3)

    def grown(n_features, depth):
        tree = model._Tree([], [], [], [], [], [])

        def grow(weight, left):
            k = len(tree.feature)
            leaf = left == 0 or weight < 2 or (left < depth and rng.random() < 0.2)
            for cells, v in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.weight), (-1 if leaf else int(rng.integers(n_features)), float(rng.integers(5)), -1, -1, float(rng.normal()), weight), strict=True):
                cells.append(v)
            if not leaf:
                part = float(rng.integers(1, int(weight)))
                tree.left[k], tree.right[k] = grow(part, left - 1), grow(weight - part, left - 1)
            return k

        grow(200.0, depth)
        return tree

    by_hand = model._Tree([0, 1, -1, -1, 0, -1, -1], [0.5, 0.3, 0, 0, 0.8, 0, 0], [1, 2, -1, -1, 5, -1, -1], [4, 3, -1, -1, 6, -1, -1], [0, 0, 1.0, 4.0, 0, 2.0, 7.0], [10, 6, 2, 4, 4, 3, 1])
    x = np.array([[0.2, 0.1], [0.2, 0.9], [0.6, 0.1], [0.9, 0.5]])
    assert np.allclose(model.tree_shap(model.leaves([by_hand]), x), [expected([by_hand], r) for r in x])
    trees = [grown(4, 5) for _ in range(6)] + [model._Tree([-1], [0.0], [-1], [-1], [3.0], [9.0])]
    x = rng.integers(-1, 6, (30, 4)).astype(float)
    x[3, 1] = np.nan
    assert np.allclose(model.tree_shap(model.leaves(trees), x, rows=7, block=10), [expected(trees, r) for r in x])


def test_exported_trees(spark):
    """Trees read from their written form are those walked node by node."""
    parts = metrics.split(eligible_rows(spark))
    trees = model.train(parts["train"], parts["validate"], max_iter=2).trees
    for read, walked in zip(model._export(spark, trees), [model._walked(t, 2 * w) for t, w in zip(trees.trees, trees.treeWeights, strict=True)], strict=True):
        inner = np.array(walked.feature) >= 0
        for name in ("feature", "left", "right", "value", "weight"):
            assert np.allclose(getattr(read, name), getattr(walked, name))
        assert np.allclose(np.array(read.threshold, float)[inner], np.array(walked.threshold)[inner])


def test_detector(spark):
    rows = eligible_rows(spark)
    training = metrics.split(rows)["train"]
    detector = anomaly.fit(training, trees=100)
    rate = detector.transform(training).agg(F.avg(F.col("anomaly_flag").cast("int"))).first()[0]
    assert abs(rate - 0.01) <= 0.005
    assert detector.cut == anomaly.fit(training, trees=100).cut
    odd = training.limit(1).withColumns({"consortium_size": F.lit(40), "log_amount": F.lit(30.0), "is_first_contract_in_project": F.lit(True), "supplier_prior_contract_count": F.lit(900).cast("long")})
    row = detector.assess(odd).first()
    assert row["anomaly_flag"] and row["anomaly_explanation"].startswith(anomaly.ONE) and anomaly.TWO in row["anomaly_explanation"]
    size, _ = detector.extremity("consortium_size")
    assert training.filter("consortium_size = 1").select(size).first()[0] < 0.2
    assert "benchmark_support_n" not in anomaly.PHRASES


def test_detector_rows_reach_the_driver_once(spark):
    """The rows of least hash are those that sorting all would give, but no partition sends as many as are asked for."""
    rows = spark.range(4000, numPartitions=8).select((F.col("id") % 900).cast("double").alias("log_amount"), (F.col("id") % 7).alias("consortium_size"))
    cells = [F.col("log_amount"), F.col("consortium_size").cast("double")]
    plain = rows.select(F.array(*cells).alias("x"), F.xxhash64(*cells, F.lit(0)).alias("h")).orderBy("h", "x")
    for n in (1, 500, 4000, 9000):
        assert anomaly._picked(rows, cells, n, 0).tolist() == [r["x"] for r in plain.limit(n).collect()]
    with pytest.raises(ValueError):
        anomaly._picked(rows.limit(0), cells, 5, 0)


def test_explanations(spark):
    detector = anomaly.Detector(anomaly.grow(np.zeros((4, 2)), 1), ("log_amount", "amount_vs_practice_median", "consortium_size", "is_competitive_method"), 0.0, {"log_amount": [float(k) for k in range(101)], "amount_vs_practice_median": [float(k) for k in range(101)], "consortium_size": [1.0] * 95 + [2.0] * 6}, {"is_competitive_method": {True: 0.9, False: 0.1}}, DEFAULT)
    rows = spark.createDataFrame([(99.0, 100.0, 1, True), (50.0, 50.0, 1, True), (50.0, 0.0, 1, False), (None, None, 2, None)], "log_amount double, amount_vs_practice_median double, consortium_size int, is_competitive_method boolean")
    got = [r[0] for r in rows.select(detector.explanation()).collect()]
    assert got[0] == "Rare among the contracts that the detector knows: it costs many times what its practice usually pays."
    assert got[1] == anomaly.ALONE
    assert got[2] == "Rare among the contracts that the detector knows: it costs a fraction of what its practice usually pays, and suppliers did not compete for it."
    assert got[3] == "Rare among the contracts that the detector knows: very many suppliers share it."


class Fixed:
    """A model with one score for all."""

    threshold, version = 0.5, "fixed"

    def __init__(self, score):
        self.score = score

    def transform(self, rows):
        return rows.withColumns({"risk_score": F.lit(self.score).cast("double"), "risk_band": F.lit("LOW")})

    def explain(self, rows):
        return rows.withColumn("top_contributing_features", F.array().cast(cohort._TOP))


class Broken(Fixed):
    def transform(self, rows):
        raise RuntimeError("broken")


class Watch:
    version = "watch"

    def __init__(self, flag):
        self.flag = flag

    def assess(self, rows):
        if self.flag is None:
            raise RuntimeError("broken")
        return rows.withColumns({"anomaly_flag": F.lit(self.flag), "anomaly_explanation": F.lit("why"), "anomaly_score": F.lit(0.0), "detector_version": F.lit("x")})


def audit(spark, made, change=None, **artefacts):
    return engine.classify_contract(spark, BASE | {"amount_usd": "20000", "consortium_size": 1} | (change or {}), cohort.Artefacts(made, **artefacts), AT)


@pytest.mark.parametrize(("scorer", "detector", "expected", "code"), [
    (Fixed(0.1), Watch(False), "ROUTINE", "MODEL_SCORE_BELOW_THRESHOLD"), (Fixed(0.5), Watch(False), "HIGH_ATTENTION", "MODEL_SCORE_ABOVE_THRESHOLD"), (Fixed(0.1), Watch(True), "HIGH_ATTENTION", "ANOMALOUS_RELATIVE_TO_TRAINING"),
    (None, Watch(False), "HIGH_ATTENTION", "MODEL_UNAVAILABLE"), (Broken(0.1), Watch(False), "HIGH_ATTENTION", "MODEL_UNAVAILABLE"), (Fixed(None), Watch(False), "HIGH_ATTENTION", "MODEL_UNAVAILABLE"),
    (Fixed(float("nan")), Watch(False), "HIGH_ATTENTION", "MODEL_UNAVAILABLE"), (Fixed(0.1), Watch(None), "HIGH_ATTENTION", "MODEL_UNAVAILABLE"), (Fixed(0.1), None, "ROUTINE", "MODEL_SCORE_BELOW_THRESHOLD"),
])
def test_cohort(spark, made, scorer, detector, expected, code):
    got = audit(spark, made, model=scorer, detector=detector)
    assert got["cohort"] == expected and code in got["reason_codes"] and got["reason_codes"] == sorted(set(got["reason_codes"]))


def test_audit_record(spark, made):
    got = audit(spark, made, model=Fixed(0.1), detector=Watch(False))
    assert len(got) == 14 and got["classification_timestamp"] == "2026-08-23T12:00:00Z"
    assert got["artefact_versions"]["model"] == "fixed" and got["feature_snapshot"]["normalized_inputs"]["region"] == "R"
    other = engine.classify_contract(spark, BASE | {"amount_usd": "20000", "consortium_size": 1}, cohort.Artefacts(made, model=Fixed(0.1), detector=Watch(False)), AT + dt.timedelta(hours=1))
    assert {k for k in got if got[k] != other[k]} == {"classification_timestamp"}
    with pytest.raises(ValueError, match="zone"):
        engine.classify_contract(spark, BASE, cohort.Artefacts(made), dt.datetime(2026, 1, 1))
    bad = audit(spark, made, {"amount_usd": "0"})
    assert bad["cohort"] == "NOT_ELIGIBLE" and bad["reason_codes"] == ["AMOUNT_NON_POSITIVE"] and bad["data_quality_fatal"]
    assert all(cohort.describe_reason(c) for c in cohort.REASONS) and len(cohort.REASONS) == 17 and not any("CLEAN" in c for c in cohort.REASONS)
    texts = cohort.describe(spark.createDataFrame([("FOREIGN_SUPPLIER",), ("AMOUNT_MISSING",), ("UNEVALUABLE::X",), ("X",)], "code string")).collect()
    assert [r["meaning"] for r in texts] == [cohort.describe_reason(r["code"]) for r in texts]


def test_override_never_lowers(spark):
    rows = spark.createDataFrame([(r, f) for r in range(4) for f in (True, False)], "r int, f boolean")
    got = [(a, b, c) for a, b, c in rows.select("r", "f", rules.override(F.col("r"), F.col("f"))).collect()]
    assert all(c == (min(a, 2) if b else a) for a, b, c in got)


def test_batch_and_records_agree(spark):
    rows = awards(spark)
    cleaned = clean.clean(rows)
    fitted = reference.plan(cleaned)
    artefacts = cohort.Artefacts(fitted)
    batch = flags.validate_batch(cleaned, fitted).withColumn("key", F.col("supplier_id"))
    given = [r.asDict() for r in rows.collect()]
    sizes = {r["supplier_id"]: r["consortium_size"] for r in cleaned.collect()}
    single = flags.enrich(records.from_records(spark, [g | {"consortium_size": sizes[g["supplier_id"]]} for g in given]), fitted).withColumn("key", F.col("supplier_id"))
    assert reports.disagreements(batch, single, "key", ["features", "data_quality_flags", "ok"]).first()["disagreements"] == 0
    a, b = (cohort.classify(t, artefacts, AT).groupBy("cohort").count().collect() for t in (batch, single))
    assert sorted(a) == sorted(b)
    mix = {r["cohort"]: r["rows"] for r in reports.cohort_mix(cohort.classify(batch, artefacts, AT)).collect()}
    assert sum(mix.values()) == 120 and mix["ROUTINE"] == 0
    checked = batch.select("ok", "features", "data_quality_flags").collect()
    assert all(r["ok"] == (r["features"] is not None) for r in checked)


def test_stream(spark, made, tmp_path):
    from awardlens.streaming.scorer import classify_stream

    rows = records.from_records(spark, [BASE | {"contract_id": k} for k in range(5)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = classify_stream(stream, cohort.Artefacts(made, model=Fixed(0.1)), str(tmp_path / "out"), str(tmp_path / "state"), clock=lambda: AT)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_empty(spark):
    cleaned = clean.clean(raw(spark, {}).limit(0))
    checked = flags.validate_batch(cleaned, reference.plan(cleaned))
    assert checked.count() == 0 and reports.quality_register(checked).count() == 24


def test_training_pipeline(spark):
    rows = awards(spark, 400)
    config = replace(DEFAULT, train_years=(2021,), validation_years=(2021,), min_group_support=5)
    checked, fitted = engine.validated(rows, config)
    artefacts = engine.train(checked, fitted, config, "logistic")
    got = engine.classify_batch(rows, artefacts, AT)
    assert got.count() == 400 and got.filter("risk_score is not null").count() == engine.eligible(checked, config).count()


def test_queries_train_the_production_model(monkeypatch):
    """Neither query cuts the trees or takes another kind, and the trees are explained."""
    from unittest.mock import MagicMock

    from awardlens import queries
    from awardlens.operators import model as trained

    fake, own, cohorts = MagicMock(), MagicMock(), MagicMock()
    monkeypatch.setattr(queries, "_lr", lambda s, d: (MagicMock(), MagicMock(), MagicMock(), MagicMock()))
    monkeypatch.setattr(queries, "F", MagicMock())
    monkeypatch.setattr(trained, "train", fake)
    monkeypatch.setattr(queries.engine, "train", own)
    monkeypatch.setattr(queries.cohort, "classify", cohorts)
    queries.gbt_scores(None, "")
    queries.classify_contracts(None, "")
    assert fake.call_args.args[2] == "gbt" and set(fake.call_args.kwargs) == {"config"}
    assert fake.return_value.explain.called
    assert own.call_args.args[3:] == () and not own.call_args.kwargs


def test_no_query_claims_the_agreement_of_the_paths():
    """The query compares two settings; that of batch and records is held by a test."""
    from awardlens.queries import QUERIES

    assert "setting_agreement" in QUERIES and "batch_agreement" not in QUERIES


def test_rows_are_not_shuffled_to_small_dimensions(spark):
    """Lines and contracts' rows stay where they are for their part and seller, whatever the optimizer's own limit."""
    from awardlens.sources import tables

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = tables.contracts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "hashpartitioning(l_suppkey" not in plan and "hashpartitioning(l_partkey" not in plan
