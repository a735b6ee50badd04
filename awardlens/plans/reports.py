"""Reports over cleaned, engineered, ruled and scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.calendar import month_year
from ..operators import flags, rules

PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
MULTIPLES = (5.0, 10.0, 20.0, 25.0, 50.0, 75.0, 100.0, 150.0)


def quality_audit(validated: DataFrame) -> DataFrame:
    """For each row its flags, whether one is fatal, and how many there are."""
    names = [c for c in ("row_id", "contract_id", "supplier_id") if c in validated.columns]
    return validated.select(*names, "data_quality_flags", flags.is_fatal("data_quality_flags").alias("fatal"), F.size("data_quality_flags").alias("n_flags"))


def quality_register(validated: DataFrame) -> DataFrame:
    """Rows of every flag, those without any too, by severity and then number."""
    found = validated.select(F.explode("data_quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))
    total = validated.agg(F.count("*").alias("total"))
    table = F.broadcast(flags.dimension(validated.sparkSession)).join(found, "flag", "left").crossJoin(F.broadcast(total))
    rows = F.coalesce("rows", F.lit(0))
    return table.select("flag", "severity", "severity_rank", rows.alias("rows"), F.round(F.try_divide(rows, F.col("total")) * 100, 3).alias("pct"), "meaning").orderBy("severity_rank", F.desc("rows"), "flag")


def amount_distribution(rows: DataFrame) -> DataFrame:
    """Number, mean, least, percentiles and most of the amounts by category, and of all."""
    stats = [F.count("amount_usd").alias("n"), F.round(F.avg("amount_usd"), 0).alias("mean"), F.round(F.min("amount_usd"), 0).alias("min")]
    stats += [F.round(F.percentile("amount_usd", F.lit(p)), 0).alias(f"p{round(p * 100):02d}") for p in PERCENTILES] + [F.round(F.max("amount_usd"), 0).alias("max")]
    each = rows.filter("procurement_category is not null").groupBy(F.col("procurement_category").alias("category")).agg(*stats)
    return rows.agg(*stats).select(F.lit("All categories").alias("category"), "*").unionByName(each)


def category_region_mix(rows: DataFrame) -> DataFrame:
    """Rows by region and category, with totals, as a long table."""
    known = rows.filter("region is not null and procurement_category is not null")
    return known.cube("region", "procurement_category").agg(F.count("*").alias("rows")).select(F.coalesce("region", F.lit("Total")).alias("region"), F.coalesce("procurement_category", F.lit("Total")).alias("procurement_category"), "rows")


def category_region_pivot(rows: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """The same with a column for each category; give the categories to spare a pass."""
    return category_region_mix(rows).groupBy("region").pivot("procurement_category", categories).agg(F.first("rows")).na.fill(0)


def fiscal_year_coverage(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows, value, median and share of prior review by fiscal year, against the median of the training years."""
    by = rows.filter("fiscal_year is not null").groupBy("fiscal_year").agg(F.count("*").alias("contracts"), F.sum("amount_usd").alias("_sum"), F.percentile("amount_usd", F.lit(0.5)).alias("_median"), F.avg(F.coalesce(F.col("review_type") == "Prior", F.lit(False)).cast("int")).alias("_prior"))
    usual = by.filter(F.col("fiscal_year").isin(*config.train_years)).agg(F.percentile("contracts", F.lit(0.5)).alias("_usual"))
    out = by.crossJoin(F.broadcast(usual)).withColumn("vs_typical", F.round(F.try_divide("contracts", "_usual"), 2))
    state = F.when(F.col("fiscal_year").isin(*config.truncated_years), "TRUNCATED - extract frozen mid-year").when(F.col("vs_typical") < 0.85, "partial - reporting lag").otherwise("complete")
    return out.select("fiscal_year", "contracts", F.round(F.col("_sum") / 1e9, 2).alias("total_usd_bn"), F.round("_median", 0).alias("median_usd"), F.round(F.col("_prior") * 100, 1).alias("prior_review_pct"), "vs_typical", state.alias("completeness"))


def region_coverage(rows: DataFrame) -> DataFrame:
    """Rows, share, value, median and share without competition, of known methods, by region."""
    total = rows.agg(F.count("*").alias("_all"))
    by = rows.filter("region is not null").groupBy("region").agg(F.count("*").alias("contracts"), F.sum("amount_usd").alias("_sum"), F.percentile("amount_usd", F.lit(0.5)).alias("_median"), F.avg((~F.col("is_competitive_method")).cast("int")).alias("_nc"))
    out = by.crossJoin(F.broadcast(total)).select("region", "contracts", F.round(F.col("contracts") / F.col("_all") * 100, 1).alias("share_pct"), F.round(F.col("_sum") / 1e9, 2).alias("total_usd_bn"), F.round("_median", 0).alias("median_usd"), F.round(F.col("_nc") * 100, 1).alias("non_competitive_pct"))
    return out.orderBy(F.desc("contracts"), "region")


def method_taxonomy(spark: SparkSession, config: EngineConfig = DEFAULT) -> DataFrame:
    rows = sorted(((m, kind, why) for m, (kind, why) in config.methods.items()), key=lambda r: (r[1], r[0]))
    return spark.createDataFrame(rows, "method string, class string, rationale string")


def consortium_impact(rows: DataFrame, grain: DataFrame) -> DataFrame:
    """What counting contracts instead of suppliers' rows changes."""
    many = F.col("is_consortium_member").cast("int")
    a = rows.agg(F.count("*").alias("supplier_rows"), F.coalesce(F.sum(many), F.lit(0)).alias("rows_in_multi_supplier_contracts"), F.max("consortium_size").cast("long").alias("largest_consortium"), F.round(F.sum("amount_usd") / 1e9, 1).alias("row_grain_total_usd_bn"))
    b = grain.agg(F.count("*").alias("distinct_contracts"), F.coalesce(F.sum(many), F.lit(0)).alias("multi_supplier_contracts"), F.round(F.sum("amount_usd") / 1e9, 1).alias("contract_grain_total_usd_bn"))
    return a.crossJoin(b)


def vintage_trend(cells: DataFrame) -> DataFrame:
    """The median of the months' benchmarks, by fiscal year and category, as a long table."""
    return cells.groupBy(month_year("m").alias("fiscal_year"), "procurement_category").agg(F.round(F.percentile("median", F.lit(0.5)), 0).alias("median_usd"))


def vintage_trend_pivot(cells: DataFrame, categories: list[str] | None = None) -> DataFrame:
    return vintage_trend(cells).groupBy("fiscal_year").pivot("procurement_category", categories).agg(F.first("median_usd"))


def vintage_coverage(engineered: DataFrame) -> DataFrame:
    """By fiscal year: rows with their own peer group's benchmark, with a wider one, and without."""

    def n(c: Column) -> Column:
        return F.sum(c.cast("int")).cast("long")

    rung = F.col("benchmark_rung")
    return engineered.filter("fiscal_year is not null").groupBy("fiscal_year").agg(F.count("*").alias("contracts"), n(rung == "exact").alias("exact_peer_benchmark"), n(rung.isin("category", "overall")).alias("widened_fallback"), n(rung == "none").alias("no_benchmark_warmup"))


def review_slice(rows: DataFrame) -> DataFrame:
    """Rows, median, 95th percentile and share without competition by type of review."""
    return rows.filter("review_type is not null").groupBy("review_type").agg(F.count("*").alias("contracts"), F.round(F.percentile("amount_usd", F.lit(0.5)), 0).alias("median_usd"), F.round(F.percentile("amount_usd", F.lit(0.95)), 0).alias("p95_usd"), F.round(F.avg((~F.col("is_competitive_method")).cast("int")) * 100, 1).alias("non_competitive_pct"))


def method_counts(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The taxonomy with each method's rows."""
    from ..functions.text import method_key

    found = rows.groupBy(method_key("procurement_method_raw").alias("_key")).agg(F.count("*").alias("rows"))
    table = method_taxonomy(rows.sparkSession, config).withColumn("_key", method_key("method"))
    return F.broadcast(table).join(found, "_key", "left").select("method", "class", F.coalesce("rows", F.lit(0)).alias("rows"))


def degenerate(validated: DataFrame) -> DataFrame:
    """The records with an amount of zero or less."""
    return validated.filter(F.array_contains("data_quality_flags", "AMOUNT_NON_POSITIVE"))


def rule_calibration(validated: DataFrame, config: EngineConfig = DEFAULT, multiples: tuple[float, ...] = MULTIPLES) -> DataFrame:
    """For each multiple of the median how many rows it catches, and together with the other rules."""
    others = [r.predicate(config) for r in rules.RULES[1:]]
    any_other = F.coalesce(others[0], F.lit(False))
    for p in others[1:]:
        any_other = any_other | F.coalesce(p, F.lit(False))
    ok = validated.filter("ok").select(F.col("amount_vs_category_region_median").alias("ratio"), any_other.alias("other"))
    cells = [x for k, m in enumerate(multiples) for x in (F.count(F.when(F.col("ratio") > m, 1)).alias(f"a{k}"), F.count(F.when((F.col("ratio") > m) | F.col("other"), 1)).alias(f"b{k}"))]
    wide = ok.agg(*cells)
    return wide.select(F.inline(F.array(*(F.struct(F.lit(m).alias("multiple"), F.col(f"a{k}").alias("over_multiple"), F.col(f"b{k}").alias("exceptional")) for k, m in enumerate(multiples)))))


def threshold_counts(validated: DataFrame, amounts: tuple[float, ...] = (250_000.0, 500_000.0, 1e6, 2e6, 5e6), ratios: tuple[float, ...] = (5.0, 10.0, 20.0, 50.0)) -> DataFrame:
    """Rows over each amount without competition, and over each ratio as the first of their project."""
    ok = validated.filter("ok")
    cells = {f"amount > {a:g}": ~F.col("is_competitive_method") & (F.col("amount_usd") > a) for a in amounts} | {f"ratio > {r:g}": F.col("is_first_contract_in_project") & (F.col("amount_vs_category_region_median") > r) for r in ratios}
    wide = ok.agg(*(F.count(F.when(c, 1)).alias(f"c{k}") for k, c in enumerate(cells.values())))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("threshold"), F.col(f"c{k}").alias("rows")) for k, n in enumerate(cells)))))


def offshore_breakdown(rows: DataFrame) -> DataFrame:
    """Rows of suppliers in secrecy jurisdictions: domestic, foreign or unknown."""
    kind = F.when(F.col("supplier_is_domestic"), "domestic").when(~F.col("supplier_is_domestic"), "foreign").otherwise("unknown")
    return rows.filter("supplier_in_secrecy_jurisdiction").groupBy(kind.alias("domesticity")).agg(F.count("*").alias("rows"))


def offshore_countries(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k countries with the most such foreign suppliers."""
    return rows.filter("supplier_in_secrecy_jurisdiction and not supplier_is_domestic").groupBy("supplier_country").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "supplier_country").limit(k)


def _outcome() -> Column:
    return F.coalesce(rules.cohort_name("cohort_rank"), F.lit("DEFERRED"))


def outcome_mix(ruled: DataFrame) -> DataFrame:
    return ruled.groupBy(_outcome().alias("outcome")).agg(F.count("*").alias("rows"))


def rule_counts(ruled: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """How often each rule fired, and couldn't be decided."""
    ok = ruled.filter("ok")
    cells = [x for k, r in enumerate(rules.RULES) for x in (F.count(F.when(F.array_contains("triggered", r.id), 1)).alias(f"a{k}"), F.count(F.when(F.array_contains("undecidable", r.id), 1)).alias(f"b{k}"))]
    return ok.agg(*cells).select(F.inline(F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.col(f"a{k}").alias("fired"), F.col(f"b{k}").alias("undecidable")) for k, r in enumerate(rules.RULES)))))


def outcome_by_year(ruled: DataFrame) -> DataFrame:
    """Rows and percentage of each outcome in its fiscal year."""
    from pyspark.sql import Window

    by = ruled.filter("fiscal_year is not null").groupBy("fiscal_year", _outcome().alias("outcome")).agg(F.count("*").alias("rows"))
    return by.withColumn("pct", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("fiscal_year")) * 100, 2))


def anomaly_rates(scored: DataFrame) -> DataFrame:
    """By split: rows, the share flagged, and the share of y among flagged and other rows. Needs split, y, anomaly_flag."""
    flag, y = F.col("anomaly_flag"), F.col("y")
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(flag.cast("int")), 4).alias("flag_rate"), F.round(F.avg(F.when(flag, y)), 4).alias("positive_rate_flagged"), F.round(F.avg(F.when(~flag, y)), 4).alias("positive_rate_other"))


def override_rescue(scored: DataFrame, threshold: float) -> DataFrame:
    """What the anomaly override moves up: rows below the threshold that are flagged, against those left. Needs p, y, anomaly_flag."""
    low, flag = F.col("p") < threshold, F.col("anomaly_flag")
    return scored.agg(F.count(F.when(low, 1)).alias("below_threshold"), F.count(F.when(low & flag, 1)).alias("promoted"), F.round(F.avg(F.when(low & flag, F.col("y"))), 4).alias("positive_rate_promoted"), F.round(F.avg(F.when(low & ~flag, F.col("y"))), 4).alias("positive_rate_left"))


def cohort_mix(audited: DataFrame) -> DataFrame:
    """Rows and percentage of every cohort, those without any too, by precedence."""
    found = audited.groupBy("cohort").agg(F.count("*").alias("rows"))
    total = audited.agg(F.count("*").alias("total"))
    names = audited.sparkSession.createDataFrame(list(enumerate(rules.COHORTS)), "rank int, cohort string")
    rows = F.coalesce("rows", F.lit(0))
    return F.broadcast(names).join(found, "cohort", "left").crossJoin(F.broadcast(total)).select("rank", "cohort", rows.alias("rows"), F.round(F.try_divide(rows, F.col("total")) * 100, 3).alias("pct")).orderBy("rank")


def disagreements(one: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows of a key differ between two classifications in any of the columns."""
    a, b = (t.select(F.col(key).alias("_k"), F.struct(*columns).alias(n)) for t, n in ((one, "a"), (other, "b")))
    return a.join(b, "_k", "full").agg(F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("disagreements"), F.count("*").alias("rows"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Rows by bins of equal width; bin 0 and bins + 1 are what lies outside."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("rows"))
