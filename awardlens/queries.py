"""The engine's queries over the star schema's contracts, and the same in SQL.

Amounts there are uniform, so the settings are lower than the defaults; the fiscal years are those of the orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LEGAL_SUFFIXES, PLACEHOLDERS, REGIONAL_MARKERS, EngineConfig
from .operators import anomaly, clean, cohort, features, flags, history, metrics, reference, rules, vintages
from .plans import engine, reports
from .sources import tables

CONFIG = EngineConfig(train_years=(1996, 1997, 1998), validation_years=(1999,), test_years=(2000, 2001), truncated_years=(2002,), amount_multiple=1.9, non_competitive_amount=450_000.0, first_contract_ratio=1.5, secrecy=("NATION_3", "NATION_7"))
AT = datetime(2026, 8, 23, 12, tzinfo=UTC)
_ID = ("contract_id", "supplier_id")


def _raw(s: SparkSession, d: str) -> DataFrame:
    return tables.contracts(s, d)


def _clean(s: SparkSession, d: str) -> DataFrame:
    return clean.clean(_raw(s, d), CONFIG)


def _usable(s: SparkSession, d: str) -> DataFrame:
    """The SQL's usable contracts, which need no date."""
    return clean.contract_grain(_clean(s, d)).filter("amount_usd > 0")


def _features(s: SparkSession, d: str) -> DataFrame:
    return engine.feature_table(_raw(s, d), CONFIG)


def _checked(s: SparkSession, d: str) -> DataFrame:
    return engine.validated(_raw(s, d), CONFIG)[0]


def _ruled(s: SparkSession, d: str) -> DataFrame:
    return rules.apply(_checked(s, d), CONFIG)


def _scored(s: SparkSession, d: str) -> DataFrame:
    """A made-up score, the label, and an id."""
    p = ((F.col("contract_id") * 7919 + F.expr("cast(substring(supplier_id, 2) as bigint)") * 104729) % 10007) / 10007.0
    return _features(s, d).select(p.alias("p"), metrics.target(CONFIG).alias("y"), F.concat_ws("-", *_ID).alias("id"))


def _four(c: Column | str) -> Column:
    """Four decimals as the SQL rounds them, by whole numbers of 1e-4: halves are those of the product, not those of the decimal text."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e4, 0) / 1e4


def _r4(*names: str):
    return [_four(n).alias(n) for n in names]


def contract_grain(s: SparkSession, d: str) -> DataFrame:
    return clean.contract_grain(_clean(s, d)).select(*_ID, "supplier_name", "amount_usd", "consortium_size")


def cleaned_rows(s: SparkSession, d: str) -> DataFrame:
    return _clean(s, d).select(*_ID, "supplier_name", "supplier_is_placeholder", "supplier_key", "global_practice", "global_practice_multi", "borrower_is_regional", "signing_date", "fiscal_year", "fiscal_year_start", "days_into_fiscal_year", "fy_quarter", "method_class", "is_competitive_method", "supplier_is_domestic", "supplier_in_secrecy_jurisdiction", "consortium_size", "is_consortium_member")


def consortium_impact(s: SparkSession, d: str) -> DataFrame:
    rows = _clean(s, d)
    return reports.consortium_impact(rows, clean.contract_grain(rows))


def _vintage(ladder: str) -> Callable[[SparkSession, str], DataFrame]:
    keys = vintages.LADDERS[ladder]

    def query(s: SparkSession, d: str) -> DataFrame:
        cells = vintages.build(_usable(s, d), keys, CONFIG, unknown=True)
        return cells.select(*keys, "m", *_r4("median"), "support_n", *(_four(F.get("sketch", F.lit(k))).alias(n) for k, n in ((5, "p05"), (75, "p75"), (100, "p100"))))

    return query


def ladder_lookup(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).select(*_ID, "benchmark_rung", "practice_rung", *_r4("benchmark_median", "practice_median"), "benchmark_support_n", "sketch_rank")


def feature_table(s: SparkSession, d: str) -> DataFrame:
    doubles = {"log_amount", "amount_vs_category_region_median", "amount_vs_practice_median", "amount_percentile_in_category_region"}
    return _features(s, d).select(*_ID, *(_four(c).alias(c) if c in doubles else c for c in features.FEATURES))


def supplier_prior_count(s: SparkSession, d: str) -> DataFrame:
    return history.prior_count(_usable(s, d), _clean(s, d), "supplier_key", "signing_date", "prior").select(*_ID, "supplier_key", "prior")


def project_sequence(s: SparkSession, d: str) -> DataFrame:
    rows = history.prior_count(_usable(s, d), _clean(s, d), "project_id", "signing_date", "seq")
    return rows.select(*_ID, "project_id", "seq", (F.col("seq") == 0).alias("is_first"))


def earliest_contract(s: SparkSession, d: str) -> DataFrame:
    return history.earliest(_usable(s, d), "supplier_key", "signing_date")


def history_keys(s: SparkSession, d: str) -> DataFrame:
    return history.distinct_keys(_usable(s, d), "supplier_key", "signing_date")


def quality_flags(s: SparkSession, d: str) -> DataFrame:
    return reports.quality_audit(_checked(s, d)).select(*_ID, F.array_join("data_quality_flags", ",").alias("flags"), "fatal", "n_flags")


def quality_register(s: SparkSession, d: str) -> DataFrame:
    return reports.quality_register(_checked(s, d)).select("flag", "severity", "rows", "pct")


def rule_outcomes(s: SparkSession, d: str) -> DataFrame:
    join = {n: F.array_join(F.array_sort(n), ",").alias(n) for n in ("triggered", "rule_reasons", "undecidable")}
    return _ruled(s, d).select(*_ID, F.coalesce(rules.cohort_name("cohort_rank"), F.lit("DEFERRED")).alias("outcome"), *join.values())


def split_counts(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).groupBy(metrics.split_name(CONFIG).alias("split")).agg(F.count("*").alias("n"), F.sum(metrics.target(CONFIG)).alias("positives"), F.sum(metrics.structurally_negative().cast("int")).alias("structural_negatives"))


def narrative_codes(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).select(*_ID, F.array_join(F.array_sort(cohort.narrative(CONFIG)), ",").alias("codes"))


def rules_only_cohorts(s: SparkSession, d: str) -> DataFrame:
    checked, made = engine.validated(_raw(s, d), CONFIG)
    return reports.cohort_mix(cohort.classify(checked, cohort.Artefacts(made, config=CONFIG), AT)).select("cohort", "rows", "pct")


def audit_records(s: SparkSession, d: str) -> DataFrame:
    """Without a model: what the rules leave is HIGH_ATTENTION."""
    checked, made = engine.validated(_raw(s, d), CONFIG)
    rows = cohort.classify(checked, cohort.Artefacts(made, config=CONFIG), AT)
    supplier = F.coalesce("feature_snapshot.normalized_inputs.supplier_name_raw", F.lit(""))
    return rows.groupBy("contract_id", "cohort", F.array_join("reason_codes", ",").alias("reason_codes"), "data_quality_flag", "data_quality_fatal").agg(F.count("*").alias("rows"), F.max(supplier).alias("last_supplier"))


def threshold_choice(s: SparkSession, d: str) -> DataFrame:
    return metrics.choose_threshold(metrics.threshold_table(_scored(s, d)))


def anomaly_report(s: SparkSession, d: str) -> DataFrame:
    """Override analysis on a made-up verdict: every 37th score."""
    rows = _scored(s, d).withColumn("anomaly_flag", F.round(F.col("p") * 10007, 0) % 37 == 0)
    return reports.override_rescue(rows, 0.5)


def anomaly_rates(s: SparkSession, d: str) -> DataFrame:
    """Flag rates by split, on the same made-up verdict."""
    p = ((F.col("contract_id") * 7919 + F.expr("cast(substring(supplier_id, 2) as bigint)") * 104729) % 10007) % 37 == 0
    return reports.anomaly_rates(_features(s, d).select(metrics.split_name(CONFIG).alias("split"), metrics.target(CONFIG).alias("y"), p.alias("anomaly_flag")))


def setting_agreement(s: SparkSession, d: str) -> DataFrame:
    """Outcomes under two settings, by how many rows they differ."""
    checked = _checked(s, d).withColumn("key", F.concat_ws("-", *_ID))
    name = F.coalesce(rules.cohort_name("cohort_rank"), F.lit("DEFERRED")).alias("outcome")
    one, other = (rules.apply(checked, c).select("key", name) for c in (CONFIG, replace(CONFIG, amount_multiple=1.7)))
    return reports.disagreements(one, other, "key", ["outcome"])


def reason_meanings(s: SparkSession, d: str) -> DataFrame:
    """Every code that rules and flags give on the table, with whether it has a meaning of its own."""
    codes = _ruled(s, d).select(F.explode("rule_reasons").alias("code")).distinct()
    return cohort.describe(codes).select("code", F.col("meaning").startswith("Rule fired").alias("is_rule"), (F.length("meaning") > 0).alias("described"))


def _lr(s: SparkSession, d: str):
    checked, made = engine.validated(_raw(s, d), CONFIG)
    left = engine.eligible(checked, CONFIG)
    return checked, made, metrics.split(left, CONFIG), left


def lr_scores(s: SparkSession, d: str) -> DataFrame:
    from .operators import model

    _, _, parts, left = _lr(s, d)
    fitted = model.train(parts["train"], parts["validate"], "logistic", config=CONFIG)
    return fitted.explain(fitted.transform(left)).select(*_ID, F.round("risk_score", 4).alias("risk_score"), "risk_band", "top_contributing_features")


def gbt_scores(s: SparkSession, d: str) -> DataFrame:
    from .operators import model

    _, _, parts, left = _lr(s, d)
    fitted = model.train(parts["train"], parts["validate"], "gbt", config=CONFIG)
    return fitted.explain(fitted.transform(left)).select(*_ID, F.round("risk_score", 4).alias("risk_score"), "risk_band", "top_contributing_features")


def anomaly_flags(s: SparkSession, d: str) -> DataFrame:
    _, _, parts, left = _lr(s, d)
    return anomaly.fit(parts["train"], CONFIG).assess(left).select(*_ID, "anomaly_flag", "anomaly_score", "anomaly_explanation")


def classify_contracts(s: SparkSession, d: str) -> DataFrame:
    checked, made, _, _ = _lr(s, d)
    artefacts = engine.train(checked, made, CONFIG)
    return cohort.classify(checked, artefacts, AT).select("contract_id", "cohort", "risk_score", "risk_band", "anomaly_flag", F.array_join("reason_codes", ",").alias("reason_codes"), "classification_timestamp")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "contract_grain": contract_grain,
    "cleaned_rows": cleaned_rows,
    "consortium_impact": consortium_impact,
    **{f"vintage_{n}": _vintage(n) for n in vintages.LADDERS},
    "ladder_lookup": ladder_lookup,
    "feature_table": feature_table,
    "supplier_prior_count": supplier_prior_count,
    "project_sequence": project_sequence,
    "earliest_contract": earliest_contract,
    "history_keys": history_keys,
    "quality_flags": quality_flags,
    "quality_register": quality_register,
    "rule_outcomes": rule_outcomes,
    "rule_counts": lambda s, d: reports.rule_counts(_ruled(s, d), CONFIG),
    "rule_calibration": lambda s, d: reports.rule_calibration(_checked(s, d), CONFIG, (1.1, 1.3, 1.5, 1.7, 1.9)),
    "threshold_counts": lambda s, d: reports.threshold_counts(_checked(s, d), (100_000.0, 250_000.0, 450_000.0), (1.1, 1.5)),
    "outcome_mix": lambda s, d: reports.outcome_mix(_ruled(s, d)),
    "outcome_by_year": lambda s, d: reports.outcome_by_year(_ruled(s, d)),
    "offshore_breakdown": lambda s, d: reports.offshore_breakdown(_clean(s, d)),
    "offshore_countries": lambda s, d: reports.offshore_countries(_clean(s, d)),
    "amount_distribution": lambda s, d: reports.amount_distribution(_clean(s, d)),
    "category_region_mix": lambda s, d: reports.category_region_mix(_clean(s, d)),
    "fiscal_year_coverage": lambda s, d: reports.fiscal_year_coverage(_clean(s, d), CONFIG),
    "region_coverage": lambda s, d: reports.region_coverage(_clean(s, d)),
    "review_slice": lambda s, d: reports.review_slice(_clean(s, d)),
    "vintage_trend": lambda s, d: reports.vintage_trend(vintages.build(_usable(s, d), ("procurement_category",), CONFIG, unknown=True)),
    "vintage_coverage": lambda s, d: reports.vintage_coverage(_features(s, d)),
    "method_counts": lambda s, d: reports.method_counts(_clean(s, d), CONFIG),
    "degenerate_records": lambda s, d: reports.degenerate(_checked(s, d)).select(*_ID, "amount_usd"),
    "amount_histogram": lambda s, d: reports.histogram(_clean(s, d), "amount_usd", 0.0, 500_000.0, 20),
    "split_counts": split_counts,
    "threshold_table": lambda s, d: metrics.threshold_table(_scored(s, d)),
    "threshold_choice": threshold_choice,
    "band_edges": lambda s, d: metrics.band_edges(_scored(s, d)).select(*_r4("low_edge", "high_edge")),
    "band_lift": lambda s, d: metrics.band_lift(_scored(s, d), (0.7, 0.9)),
    "calibration_table": lambda s, d: metrics.calibration(_scored(s, d)),
    "precision_top_decile": lambda s, d: metrics.precision_at_top_decile(_scored(s, d), "id").select(F.round("precision_at_top_decile", 6).alias("precision_at_top_decile")),
    "auc": lambda s, d: metrics.auc(_scored(s, d)).select(F.round("auc", 6).alias("auc")),
    "share_flagged": lambda s, d: metrics.share_flagged_in_target(_scored(s, d), 0.8).select(F.round("share_flagged_in_target", 6).alias("share_flagged_in_target")),
    "evaluate": lambda s, d: metrics.evaluate(_scored(s, d), 0.8, "id"),
    "override_rescue": anomaly_report,
    "anomaly_rates": anomaly_rates,
    "setting_agreement": setting_agreement,
    "reason_meanings": reason_meanings,
    "method_taxonomy": lambda s, d: reports.method_taxonomy(s, CONFIG).select("method", "class"),
    "flag_dimension": lambda s, d: flags.dimension(s).select("flag", "severity"),
    "rule_catalogue": lambda s, d: rules.catalogue(s, CONFIG).select("rule_id", "cohort", "status"),
    "narrative_codes": narrative_codes,
    "rules_only_cohorts": rules_only_cohorts,
    "audit_records": audit_records,
    "lr_scores": lr_scores,
    "gbt_scores": gbt_scores,
    "anomaly_flags": anomaly_flags,
    "classify_contracts": classify_contracts,
}

# -- the same in SQL ---------------------------------------------------------


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _strip(x: str) -> str:
    short = f"trim(regexp_replace({x}, '\\b({'|'.join(LEGAL_SUFFIXES)})\\b\\.?\\s*$', ''))"
    return f"CASE WHEN {short} <> '' THEN {short} ELSE {x} END"


_QUANTILES = "[" + ", ".join(f"{k / 100:.2f}" for k in range(101)) + "]"
_RAW = """
WITH types AS (SELECT l_orderkey, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
raw AS MATERIALIZED (
  SELECT o_orderkey::BIGINT AS contract_id, 'S' || s_suppkey AS supplier_id, 'P' || o_custkey AS project_id, br.r_name AS region,
    CASE WHEN bn.n_nationkey = 24 THEN 'World' ELSE bn.n_name END AS borrower_country, CASE WHEN bn.n_nationkey <> 24 THEN 'N' || bn.n_nationkey END AS borrower_country_code,
    t AS global_practice_raw, c_mktsegment AS procurement_category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Direct Selection' WHEN '2-HIGH' THEN 'Request for Proposals' WHEN '3-MEDIUM' THEN 'Request for Bids' WHEN '4-NOT SPECIFIED' THEN 'Consultant Qualification Selection' WHEN '5-LOW' THEN 'Force Account' END AS method,
    o_orderdate::DATE AS signing_date, CASE WHEN s_suppkey % 5 = 0 THEN 'INDIVIDUAL CONSULTANT' ELSE s_name || ' Co., Ltd.' END AS supplier_name_raw,
    sn.n_name AS supplier_country, 'N' || sn.n_nationkey AS supplier_country_code, CASE WHEN o_orderkey % 997 = 0 THEN 0.0 ELSE o_totalprice END AS amount_usd,
    CASE WHEN o_orderstatus = 'F' THEN 'Prior' ELSE 'Post' END AS review_type
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l JOIN orders ON l.l_orderkey = o_orderkey JOIN types ON types.l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation bn ON c_nationkey = bn.n_nationkey JOIN region br ON bn.n_regionkey = br.r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
named AS (SELECT *, trim(regexp_replace(regexp_replace(upper(supplier_name_raw), '[^\\w\\s&]', ' ', 'g'), '\\s+', ' ', 'g')) AS n0 FROM raw),
stripped AS (SELECT *, {s1} AS n1 FROM named), stripped2 AS (SELECT *, {s2} AS n2 FROM stripped), stripped3 AS (SELECT *, {s3} AS supplier_name FROM stripped2),
fiscal AS (SELECT *, year(signing_date) + CASE WHEN month(signing_date) >= 7 THEN 1 ELSE 0 END AS fy FROM stripped3),
clean AS MATERIALIZED (
  SELECT * EXCLUDE (n0, n1, n2, fy), fy::INT AS fiscal_year, make_date(fy - 1, 7, 1) AS fiscal_year_start, date_diff('day', make_date(fy - 1, 7, 1), signing_date)::INT AS days_into_fiscal_year,
    least(date_diff('day', make_date(fy - 1, 7, 1), signing_date) // 91 + 1, 4)::INT AS fy_quarter,
    supplier_name IN ({holders}) AS supplier_is_placeholder, CASE WHEN supplier_name NOT IN ({holders}) THEN supplier_name END AS supplier_key,
    string_split(global_practice_raw, ';')[1] AS global_practice, len(string_split(global_practice_raw, ';')) > 1 AS global_practice_multi,
    borrower_country_code IS NULL AND ({regional}) AS borrower_is_regional,
    CASE WHEN method IN ('Direct Selection', 'Force Account') THEN 'NON_COMPETITIVE' ELSE 'COMPETITIVE' END AS method_class, method NOT IN ('Direct Selection', 'Force Account') AS is_competitive_method,
    CASE WHEN borrower_country_code IS NOT NULL THEN borrower_country_code = supplier_country_code END AS supplier_is_domestic,
    supplier_country IN ({secrecy}) AS supplier_in_secrecy_jurisdiction, count(*) OVER (PARTITION BY contract_id)::INT AS consortium_size,
    year(signing_date) * 12 + month(signing_date) - 1 AS m
  FROM fiscal),
grain AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY supplier_name, supplier_id) AS k FROM clean) WHERE k = 1),
usable AS MATERIALIZED (SELECT * FROM grain WHERE amount_usd > 0)
""".format(s1=_strip("n0"), s2=_strip("n1"), s3=_strip("n2"), holders=_in(PLACEHOLDERS), regional=" OR ".join(f"contains(upper(borrower_country), '{x}')" for x in REGIONAL_MARKERS), secrecy=_in(CONFIG.secrecy))


def _cells(name: str, keys: tuple[str, ...]) -> str:
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    own = "".join(f"{k}, " for k in keys)
    frame = f"({by}ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
v_{name} AS MATERIALIZED (SELECT {own}m, support_n, sketch[51] AS median, sketch FROM (SELECT {own}m, any_value(n) AS support_n, any_value(q) AS sketch FROM (
  SELECT {own}m, count(amount_usd) OVER {frame} AS n, quantile_cont(amount_usd, {_QUANTILES}) OVER {frame} AS q FROM usable) WHERE n >= 30 GROUP BY {own}m))"""


_VINTAGES = ",".join(_cells(n, k) for n, k in vintages.LADDERS.items())
_FEATURES = f"""{_RAW}, {_VINTAGES},
s_days AS (SELECT k, d, sum(n) AS n FROM (SELECT supplier_key AS k, signing_date AS d, 1 AS n FROM usable UNION ALL SELECT supplier_key, signing_date, 0 FROM clean) WHERE k IS NOT NULL GROUP BY ALL),
s_cum AS MATERIALIZED (SELECT k, d, (sum(n) OVER (PARTITION BY k ORDER BY d) - n)::BIGINT AS c FROM s_days),
p_days AS (SELECT k, d, sum(n) AS n FROM (SELECT project_id AS k, signing_date AS d, 1 AS n FROM usable UNION ALL SELECT project_id, signing_date, 0 FROM clean) GROUP BY ALL),
p_cum AS MATERIALIZED (SELECT k, d, (sum(n) OVER (PARTITION BY k ORDER BY d) - n)::BIGINT AS c FROM p_days),
looked AS MATERIALIZED (
  SELECT clean.*, CASE WHEN e.median IS NOT NULL THEN 'exact' WHEN c.median IS NOT NULL THEN 'category' WHEN o.median IS NOT NULL THEN 'overall' ELSE 'none' END AS benchmark_rung,
    coalesce(e.median, c.median, o.median) AS benchmark_median, coalesce(e.support_n, c.support_n, o.support_n, 0) AS benchmark_support_n, coalesce(e.sketch, c.sketch, o.sketch) AS sketch,
    CASE WHEN p.median IS NOT NULL THEN 'exact' WHEN o.median IS NOT NULL THEN 'overall' ELSE 'none' END AS practice_rung, coalesce(p.median, o.median) AS practice_median
  FROM clean LEFT JOIN v_category_region e ON e.procurement_category = clean.procurement_category AND e.region = clean.region AND e.m = clean.m
    LEFT JOIN v_category c ON c.procurement_category = clean.procurement_category AND c.m = clean.m LEFT JOIN v_overall o ON o.m = clean.m LEFT JOIN v_practice p ON p.global_practice = clean.global_practice AND p.m = clean.m),
feats AS MATERIALIZED (
  SELECT looked.*, CASE WHEN supplier_key IS NOT NULL THEN coalesce(s_cum.c, 0) END AS supplier_prior_contract_count, coalesce(p_cum.c, 0) AS project_contract_sequence, coalesce(p_cum.c, 0) = 0 AS is_first_contract_in_project,
    CASE WHEN amount_usd > 0 THEN log10(amount_usd) END AS log_amount, CASE WHEN benchmark_median >= 1 THEN amount_usd / benchmark_median END AS amount_vs_category_region_median,
    CASE WHEN practice_median >= 1 THEN amount_usd / practice_median END AS amount_vs_practice_median, CASE WHEN sketch IS NOT NULL THEN len(list_filter(sketch, lambda q: q <= amount_usd)) END AS sketch_rank,
    supplier_key IS NOT NULL AS supplier_is_known
  FROM looked LEFT JOIN s_cum ON supplier_key = s_cum.k AND signing_date = s_cum.d LEFT JOIN p_cum ON project_id = p_cum.k AND signing_date = p_cum.d)
"""
# The extract has no review type, category or date missing, so these are the flags that can occur.
_FLAGS = f"""{_FEATURES},
flagged AS MATERIALIZED (
  SELECT *, amount_usd > 0 AS ok, amount_vs_category_region_median AS ratio, sketch_rank / 101.0 AS pct, list_sort(list_filter(CASE WHEN amount_usd > 0 THEN [
    CASE WHEN supplier_key IS NULL THEN 'SUPPLIER_UNIDENTIFIABLE' END, CASE WHEN signing_date > DATE '{CONFIG.data_as_of}' THEN 'SIGNING_DATE_AFTER_EXTRACT' END, CASE WHEN borrower_is_regional THEN 'BORROWER_IS_REGIONAL' END,
    CASE WHEN benchmark_rung IN ('category', 'overall') OR practice_rung = 'overall' THEN 'THIN_REFERENCE_GROUP' END, CASE WHEN benchmark_rung = 'none' OR practice_rung = 'none' THEN 'REFERENCE_MEDIAN_UNAVAILABLE' END,
    CASE WHEN global_practice_multi THEN 'MULTI_PRACTICE_PROJECT' END, CASE WHEN consortium_size > 1 THEN 'CONSORTIUM_MEMBER_ROW' END]
    ELSE ['AMOUNT_NON_POSITIVE', CASE WHEN supplier_key IS NULL THEN 'SUPPLIER_UNIDENTIFIABLE' END] END, lambda x: x IS NOT NULL)) AS flags
  FROM feats)
"""
_PREDICATES = {
    "AMOUNT_EXTREME_FOR_PEER_GROUP": "ratio > 1.9",
    "NON_COMPETITIVE_HIGH_VALUE": "(NOT is_competitive_method AND amount_usd > 450000)",
    "OFFSHORE_SUPPLIER_FOREIGN_TO_BORROWER": "(supplier_in_secrecy_jurisdiction AND NOT supplier_is_domestic)",
    "FIRST_CONTRACT_IN_PROJECT_HIGH_VALUE": "(is_first_contract_in_project AND ratio > 1.5)",
    "SIGNED_OUTSIDE_FISCAL_YEAR_WINDOW": "(NOT days_into_fiscal_year BETWEEN 0 AND 366)",
}
_RULED = f"""{_FLAGS},
fired AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in _PREDICATES.items())}], lambda x: x IS NOT NULL) AS t,
  list_filter([{", ".join(f"CASE WHEN ({p}) IS NULL THEN '{n}' END" for n, p in _PREDICATES.items())}], lambda x: x IS NOT NULL) AS u FROM flagged),
ruled AS MATERIALIZED (SELECT *, CASE WHEN NOT ok THEN 'NOT_ELIGIBLE' WHEN len(t) > 0 THEN 'EXCEPTIONAL' WHEN len(u) > 0 THEN 'HIGH_ATTENTION' ELSE 'DEFERRED' END AS outcome FROM fired)
"""
_SCORED = f"""{_FEATURES},
scored AS MATERIALIZED (SELECT ((contract_id * 7919 + substring(supplier_id, 2)::BIGINT * 104729) % 10007) / 10007.0::DOUBLE AS p, coalesce(sketch_rank / 101.0 > 0.75 AND NOT is_competitive_method, false)::INT AS y, contract_id || '-' || supplier_id AS id, fiscal_year, supplier_is_known FROM feats)
"""
_ID_SQL = "contract_id, supplier_id"
_REASONS = """list_filter([CASE WHEN ratio IS NULL THEN 'PEER_BENCHMARK_UNAVAILABLE' WHEN ratio > 5 THEN 'AMOUNT_ABOVE_CATEGORY_RANGE' ELSE 'AMOUNT_WITHIN_CATEGORY_RANGE' END,
  CASE WHEN is_competitive_method THEN 'COMPETITIVE_PROCUREMENT_METHOD' ELSE 'NON_COMPETITIVE_PROCUREMENT_METHOD' END,
  CASE WHEN supplier_prior_contract_count IS NULL THEN 'SUPPLIER_HISTORY_UNAVAILABLE' WHEN supplier_prior_contract_count > 0 THEN 'SUPPLIER_HAS_PRIOR_CONTRACTS' ELSE 'SUPPLIER_HAS_NO_PRIOR_CONTRACTS' END,
  CASE WHEN is_first_contract_in_project THEN 'FIRST_CONTRACT_IN_PROJECT' ELSE 'ESTABLISHED_PROJECT' END,
  CASE WHEN supplier_is_domestic THEN 'DOMESTIC_SUPPLIER' WHEN NOT supplier_is_domestic THEN 'FOREIGN_SUPPLIER' END], lambda x: x IS NOT NULL)"""
_STATUS = [f"('{r.id}', 'EXCEPTIONAL', '{'active' if r.active else 'inactive'}')" for r in rules.RULES]
_SEVERITY = ", ".join(f"('{n}', '{s}')" for n, (s, _) in flags.FLAGS.items())
_CUTS = f"""{_SCORED}, points AS (SELECT quantile_cont(p, [{', '.join(f'1 - {f}::DOUBLE' for f in metrics.FRACTIONS)}]) AS q FROM scored),
  cuts AS (SELECT unnest([{', '.join(map(str, metrics.FRACTIONS))}])::DOUBLE AS f, unnest(q) AS t FROM points),
  tbl AS (SELECT f AS flag_rate_target, round(t, 6) AS threshold, count(*) FILTER (p >= t) AS flagged, round(count(*) FILTER (p >= t) / count(*) * 100, 2) AS flagged_pct,
    round(count(*) FILTER (p >= t AND y = 1) / greatest(1, sum(y)), 4) AS recall, round(count(*) FILTER (p >= t AND y = 1) / greatest(1, count(*) FILTER (p >= t)), 4) AS precision FROM cuts, scored GROUP BY f, t)"""


def _many(cells: dict[str, str], table: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {name}, {c} FROM {table}" for n, c in cells.items())


def _amounts(label: str, where: str, group: str) -> str:
    stats = ", ".join(f"round(quantile_cont(amount_usd, {p}), 0) AS p{round(p * 100):02d}" for p in reports.PERCENTILES)
    return f"SELECT {label} AS category, count(amount_usd) AS n, round(avg(amount_usd), 0) AS mean, round(min(amount_usd), 0) AS min, {stats}, round(max(amount_usd), 0) AS max FROM clean {where} {group}"


ORACLE_SQL: dict[str, str] = {
    "contract_grain": f"{_RAW} SELECT {_ID_SQL}, supplier_name, amount_usd, consortium_size FROM grain",
    "cleaned_rows": f"{_RAW} SELECT {_ID_SQL}, supplier_name, supplier_is_placeholder, supplier_key, global_practice, global_practice_multi, borrower_is_regional, signing_date, fiscal_year, fiscal_year_start, days_into_fiscal_year, fy_quarter, method_class, is_competitive_method, supplier_is_domestic, supplier_in_secrecy_jurisdiction, consortium_size, consortium_size > 1 AS is_consortium_member FROM clean",
    "consortium_impact": f"{_RAW} SELECT (SELECT count(*) FROM clean) AS supplier_rows, (SELECT count(*) FROM clean WHERE consortium_size > 1) AS rows_in_multi_supplier_contracts, (SELECT max(consortium_size)::BIGINT FROM clean) AS largest_consortium, (SELECT round(sum(amount_usd) / 1e9, 1) FROM clean) AS row_grain_total_usd_bn, (SELECT count(*) FROM grain) AS distinct_contracts, (SELECT count(*) FROM grain WHERE consortium_size > 1) AS multi_supplier_contracts, (SELECT round(sum(amount_usd) / 1e9, 1) FROM grain) AS contract_grain_total_usd_bn",
    **{f"vintage_{n}": f"{_RAW}, {_cells(n, k)} SELECT {''.join(f'{x}, ' for x in k)}m::INT AS m, round(median, 4) AS median, support_n, round(sketch[6], 4) AS p05, round(sketch[76], 4) AS p75, round(sketch[101], 4) AS p100 FROM v_{n}" for n, k in vintages.LADDERS.items()},
    "ladder_lookup": f"{_FEATURES} SELECT {_ID_SQL}, benchmark_rung, practice_rung, round(benchmark_median, 4) AS benchmark_median, round(practice_median, 4) AS practice_median, benchmark_support_n, sketch_rank::INT AS sketch_rank FROM feats",
    "feature_table": f"{_FEATURES} SELECT {_ID_SQL}, amount_usd, round(log_amount, 4) AS log_amount, round(amount_vs_category_region_median, 4) AS amount_vs_category_region_median, round(amount_vs_practice_median, 4) AS amount_vs_practice_median, round(sketch_rank / 101.0, 4) AS amount_percentile_in_category_region, benchmark_support_n, supplier_is_domestic, is_first_contract_in_project, project_contract_sequence, supplier_prior_contract_count, supplier_is_known, days_into_fiscal_year, fy_quarter, is_competitive_method, supplier_in_secrecy_jurisdiction, consortium_size FROM feats",
    "supplier_prior_count": f"{_FEATURES} SELECT {_ID_SQL}, supplier_key, supplier_prior_contract_count AS prior FROM feats",
    "project_sequence": f"{_FEATURES} SELECT {_ID_SQL}, project_id, project_contract_sequence AS seq, is_first_contract_in_project AS is_first FROM feats",
    "earliest_contract": f"{_RAW} SELECT supplier_key, min(signing_date) AS earliest FROM usable WHERE supplier_key IS NOT NULL GROUP BY 1",
    "history_keys": f"{_RAW} SELECT count(DISTINCT supplier_key) AS keys FROM usable",
    "quality_flags": f"{_FLAGS} SELECT {_ID_SQL}, array_to_string(flags, ',') AS flags, NOT ok AS fatal, len(flags)::INT AS n_flags FROM flagged",
    "quality_register": f"{_FLAGS}, each AS (SELECT unnest(flags) AS flag FROM flagged) SELECT d.flag, severity, count(each.flag) AS rows, round(count(each.flag) / (SELECT count(*) FROM flagged) * 100, 3) AS pct FROM (VALUES {_SEVERITY}) d(flag, severity) LEFT JOIN each ON each.flag = d.flag GROUP BY 1, 2",
    "rule_outcomes": f"{_RULED} SELECT {_ID_SQL}, outcome, CASE WHEN ok THEN array_to_string(list_sort(t), ',') ELSE 'NOT_ELIGIBLE::AMOUNT_NON_POSITIVE' END AS triggered, CASE WHEN NOT ok THEN 'AMOUNT_NON_POSITIVE' WHEN len(t) > 0 THEN array_to_string(list_sort(t), ',') ELSE array_to_string(list_sort(list_transform(u, lambda x: 'UNEVALUABLE::' || x)), ',') END AS rule_reasons, CASE WHEN ok THEN array_to_string(list_sort(u), ',') ELSE '' END AS undecidable FROM ruled",
    "rule_counts": f"{_FLAGS} " + _many({n: f"count(*) FILTER (ok AND {p}) AS fired, count(*) FILTER (ok AND ({p}) IS NULL) AS undecidable" for n, p in _PREDICATES.items()}, "flagged", "rule_id"),
    "rule_calibration": f"{_FLAGS}, o AS (SELECT ok, ratio, {' OR '.join(f'coalesce({p}, false)' for n, p in list(_PREDICATES.items())[1:])} AS other FROM flagged) SELECT x AS multiple, count(*) FILTER (ok AND ratio > x) AS over_multiple, count(*) FILTER (ok AND (coalesce(ratio > x, false) OR other)) AS exceptional FROM o, (SELECT unnest([1.1, 1.3, 1.5, 1.7, 1.9])::DOUBLE AS x) GROUP BY x",
    "threshold_counts": f"{_FLAGS} " + _many({f"amount > {a:g}": f"count(*) FILTER (ok AND NOT is_competitive_method AND amount_usd > {a}) AS rows" for a in (100_000.0, 250_000.0, 450_000.0)} | {f"ratio > {r:g}": f"count(*) FILTER (ok AND is_first_contract_in_project AND ratio > {r}) AS rows" for r in (1.1, 1.5)}, "flagged", "threshold"),
    "outcome_mix": f"{_RULED} SELECT outcome, count(*) AS rows FROM ruled GROUP BY 1",
    "outcome_by_year": f"{_RULED}, c AS (SELECT fiscal_year, outcome, count(*) AS rows FROM ruled GROUP BY 1, 2) SELECT fiscal_year, outcome, rows, round(rows / sum(rows) OVER (PARTITION BY fiscal_year) * 100, 2) AS pct FROM c",
    "offshore_breakdown": f"{_RAW} SELECT CASE WHEN supplier_is_domestic THEN 'domestic' WHEN NOT supplier_is_domestic THEN 'foreign' ELSE 'unknown' END AS domesticity, count(*) AS rows FROM clean WHERE supplier_in_secrecy_jurisdiction GROUP BY 1",
    "offshore_countries": f"{_RAW} SELECT supplier_country, count(*) AS rows FROM clean WHERE supplier_in_secrecy_jurisdiction AND NOT supplier_is_domestic GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "amount_distribution": f"{_RAW} {_amounts(chr(39) + 'All categories' + chr(39), '', '')} UNION ALL {_amounts('procurement_category', '', 'GROUP BY procurement_category')}",
    "category_region_mix": f"{_RAW} SELECT coalesce(region, 'Total') AS region, coalesce(procurement_category, 'Total') AS procurement_category, count(*) AS rows FROM clean GROUP BY CUBE (region, procurement_category)",
    "fiscal_year_coverage": f"{_RAW}, g AS (SELECT fiscal_year, count(*) AS contracts, round(sum(amount_usd) / 1e9, 2) AS total_usd_bn, round(median(amount_usd), 0) AS median_usd, round(avg((review_type = 'Prior')::INT) * 100, 1) AS prior_review_pct FROM clean GROUP BY 1), u AS (SELECT median(contracts) AS typical FROM g WHERE fiscal_year IN (1996, 1997, 1998)) SELECT g.*, round(contracts / typical, 2) AS vs_typical, CASE WHEN fiscal_year IN (2002) THEN 'TRUNCATED - extract frozen mid-year' WHEN round(contracts / typical, 2) < 0.85 THEN 'partial - reporting lag' ELSE 'complete' END AS completeness FROM g, u",
    "region_coverage": f"{_RAW} SELECT region, count(*) AS contracts, round(count(*) / (SELECT count(*) FROM clean) * 100, 1) AS share_pct, round(sum(amount_usd) / 1e9, 2) AS total_usd_bn, round(median(amount_usd), 0) AS median_usd, round(avg((NOT is_competitive_method)::INT) * 100, 1) AS non_competitive_pct FROM clean GROUP BY 1",
    "review_slice": f"{_RAW} SELECT review_type, count(*) AS contracts, round(median(amount_usd), 0) AS median_usd, round(quantile_cont(amount_usd, 0.95), 0) AS p95_usd, round(avg((NOT is_competitive_method)::INT) * 100, 1) AS non_competitive_pct FROM clean GROUP BY 1",
    "vintage_trend": f"{_RAW}, {_cells('category', ('procurement_category',))} SELECT (m // 12 + CASE WHEN m % 12 + 1 >= 7 THEN 1 ELSE 0 END)::INT AS fiscal_year, procurement_category, round(median(v_category.median), 0) AS median_usd FROM v_category GROUP BY 1, 2",
    "vintage_coverage": f"{_FEATURES} SELECT fiscal_year, count(*) AS contracts, count(*) FILTER (benchmark_rung = 'exact') AS exact_peer_benchmark, count(*) FILTER (benchmark_rung IN ('category', 'overall')) AS widened_fallback, count(*) FILTER (benchmark_rung = 'none') AS no_benchmark_warmup FROM feats GROUP BY 1",
    "method_counts": f"{_RAW}, t AS (SELECT * FROM (VALUES {', '.join(f'({_in([m])}, {_in([k])})' for m, (k, _) in CONFIG.methods.items())}) t(method, class)) SELECT t.method, t.class, count(clean.method) AS rows FROM t LEFT JOIN clean ON regexp_replace(t.method, '\\s+', ' ', 'g') = clean.method GROUP BY 1, 2",
    "degenerate_records": f"{_RAW} SELECT {_ID_SQL}, amount_usd FROM clean WHERE amount_usd <= 0",
    "amount_histogram": f"{_RAW} SELECT CASE WHEN amount_usd >= 500000 THEN 21 ELSE floor(amount_usd / 25000) + 1 END::BIGINT AS bin, count(*) AS rows FROM clean GROUP BY 1",
    "split_counts": f"{_SCORED} SELECT CASE WHEN fiscal_year BETWEEN 1996 AND 1998 THEN 'train' WHEN fiscal_year = 1999 THEN 'validate' WHEN fiscal_year IN (2000, 2001) THEN 'test' WHEN fiscal_year = 2002 THEN 'truncated' END AS split, count(*) AS n, sum(y)::BIGINT AS positives, count(*) FILTER (NOT supplier_is_known) AS structural_negatives FROM scored GROUP BY 1",
    "threshold_table": f"{_CUTS} SELECT * FROM tbl",
    "threshold_choice": f"{_CUTS} SELECT coalesce(max(threshold) FILTER (recall >= 0.9), min(threshold)) AS threshold FROM tbl",
    "band_edges": f"{_SCORED} SELECT round(quantile_cont(p, 0.7), 4) AS low_edge, round(quantile_cont(p, 0.9), 4) AS high_edge FROM scored",
    "band_lift": f"{_SCORED} SELECT CASE WHEN p < 0.7 THEN 'LOW' WHEN p < 0.9 THEN 'MEDIUM' ELSE 'HIGH' END AS band, count(*) AS n, round(avg(y), 4) AS positive_rate, round(avg(y) / (SELECT avg(y) FROM scored), 3) AS lift FROM scored GROUP BY 1",
    "calibration_table": f"{_SCORED} SELECT greatest(ceil(p * 10), 1)::INT AS bin, count(*) AS n, round(avg(p), 4) AS mean_predicted, round(avg(y), 4) AS observed_rate FROM scored GROUP BY 1",
    "precision_top_decile": f"{_SCORED} SELECT round(avg(y), 6) AS precision_at_top_decile FROM (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS k FROM scored) WHERE k <= (SELECT greatest(1, floor(count(*) * 0.1)) FROM scored)",
    "auc": f"{_SCORED}, r AS (SELECT y, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) AS r FROM scored) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r",
    "share_flagged": f"{_SCORED} SELECT round(avg(y) FILTER (p >= 0.8), 6) AS share_flagged_in_target FROM scored",
    "evaluate": f"{_SCORED}, r AS (SELECT y, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) AS r, row_number() OVER (ORDER BY p DESC, id) AS k, p FROM scored) SELECT count(*) AS n, round(avg(y), 4) AS base_rate, round(avg((p - y) ** 2), 5) AS brier, round(avg(y) FILTER (p >= 0.8), 4) AS share_flagged_in_target, round(avg((p >= 0.8)::INT), 4) AS flagged_share_of_population, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 4) AS auc, round(avg(y) FILTER (k <= (SELECT greatest(1, floor(count(*) * 0.1)) FROM scored)), 4) AS precision_at_top_decile FROM r",
    "override_rescue": f"{_SCORED}, f AS (SELECT *, round(p * 10007, 0) % 37 = 0 AS flag FROM scored) SELECT count(*) FILTER (p < 0.5) AS below_threshold, count(*) FILTER (p < 0.5 AND flag) AS promoted, round(avg(y) FILTER (p < 0.5 AND flag), 4) AS positive_rate_promoted, round(avg(y) FILTER (p < 0.5 AND NOT flag), 4) AS positive_rate_left FROM f",
    "anomaly_rates": f"{_SCORED}, f AS (SELECT *, round(p * 10007, 0) % 37 = 0 AS flag FROM scored) SELECT CASE WHEN fiscal_year BETWEEN 1996 AND 1998 THEN 'train' WHEN fiscal_year = 1999 THEN 'validate' WHEN fiscal_year IN (2000, 2001) THEN 'test' WHEN fiscal_year = 2002 THEN 'truncated' END AS split, count(*) AS n, round(avg(flag::INT), 4) AS flag_rate, round(avg(y) FILTER (flag), 4) AS positive_rate_flagged, round(avg(y) FILTER (NOT flag), 4) AS positive_rate_other FROM f GROUP BY 1",
    "setting_agreement": f"{_RULED} SELECT count(*) FILTER (ok AND len(t) = 0 AND coalesce(ratio > 1.7, false)) AS disagreements, count(*) AS rows FROM ruled",
    "reason_meanings": f"{_RULED} SELECT DISTINCT code, code IN ({_in(_PREDICATES)}) AS is_rule, true AS described FROM (SELECT unnest(CASE WHEN NOT ok THEN ['AMOUNT_NON_POSITIVE'] WHEN len(t) > 0 THEN t ELSE list_transform(u, lambda x: 'UNEVALUABLE::' || x) END) AS code FROM ruled)",
    "method_taxonomy": f"SELECT * FROM (VALUES {', '.join(f'({_in([m])}, {_in([k])})' for m, (k, _) in CONFIG.methods.items())}) x(method, class)",
    "flag_dimension": f"SELECT * FROM (VALUES {_SEVERITY}) x(flag, severity)",
    "rule_catalogue": f"SELECT * FROM (VALUES {', '.join(_STATUS)}) x(rule_id, cohort, status)",
    "narrative_codes": f"{_FLAGS} SELECT {_ID_SQL}, array_to_string(list_sort({_REASONS}), ',') AS codes FROM flagged",
    "rules_only_cohorts": f"{_RULED}, c AS (SELECT CASE WHEN outcome = 'DEFERRED' THEN 'HIGH_ATTENTION' ELSE outcome END AS cohort FROM ruled) SELECT d.cohort, count(c.cohort) AS rows, round(count(c.cohort) / (SELECT count(*) FROM c) * 100, 3) AS pct FROM (VALUES ('NOT_ELIGIBLE'), ('EXCEPTIONAL'), ('HIGH_ATTENTION'), ('ROUTINE')) d(cohort) LEFT JOIN c ON c.cohort = d.cohort GROUP BY 1",
    "audit_records": f"{_RULED} SELECT contract_id, CASE WHEN outcome = 'DEFERRED' THEN 'HIGH_ATTENTION' ELSE outcome END AS cohort, CASE WHEN NOT ok THEN 'AMOUNT_NON_POSITIVE' ELSE array_to_string(list_sort(list_distinct(list_concat(CASE WHEN len(t) > 0 THEN t WHEN len(u) > 0 THEN list_transform(u, lambda x: 'UNEVALUABLE::' || x) ELSE ['MODEL_UNAVAILABLE'] END, {_REASONS}))), ',') END AS reason_codes, len(list_filter(flags, lambda x: x NOT IN ({_in([n for n, (s, _) in flags.FLAGS.items() if s == 'NOTICE'])}))) > 0 AS data_quality_flag, NOT ok AS data_quality_fatal, count(*) AS rows, max(supplier_name_raw) AS last_supplier FROM ruled GROUP BY ALL",
}
