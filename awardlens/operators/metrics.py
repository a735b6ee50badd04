"""Labels, splits, and measures of a score. Scored tables have a label y (0, 1), a score p and an id to break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig

FRACTIONS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70)
BANDS = ("LOW", "MEDIUM", "HIGH")
#: Ranges of scores that are ranked apart, each by a task.
RANGES = 1024


def _range() -> Column:
    """The range of the score p, from 0 to 1; all others, and none, count as the nearest."""
    return F.coalesce(F.least(F.greatest(F.floor(F.col("p") * RANGES), F.lit(0)), F.lit(RANGES - 1)), F.lit(-1)).cast("int")


def _before(by: DataFrame, *names: str, descending: bool = False) -> DataFrame:
    """For distinct scores, _x_before of each named column x: its sum over the lower scores, or the higher ones.

    Sums within a range of scores, and RANGES sums of ranges: no task ranks all scores.
    """
    down = F.desc if descending else F.asc
    ranged = by.withColumn("_range", _range())
    totals = ranged.groupBy("_range").agg(*(F.sum(x).alias(f"_{x}_sum") for x in names))
    over = Window.orderBy(down("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{x}_sum").over(over), F.lit(0)).alias(f"_{x}_base") for x in names))
    within = Window.partitionBy("_range").orderBy(down("p")).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumns({f"_{x}_own": F.coalesce(F.sum(x).over(within), F.lit(0)) for x in names})
    return ranged.join(F.broadcast(totals), "_range").select(*by.columns, *((F.col(f"_{x}_base") + F.col(f"_{x}_own")).alias(f"_{x}_before") for x in names))


def target(config: EngineConfig = DEFAULT) -> Column:
    """Among the largest of its peer group and without competition; unknown is 0."""
    return F.coalesce((F.col("amount_percentile_in_category_region") > config.target_quantile) & ~F.col("is_competitive_method"), F.lit(False)).cast("int")


def structurally_negative() -> Column:
    """A record whose supplier isn't known can hardly be positive."""
    return ~F.coalesce(F.col("supplier_is_known"), F.lit(False))


def split(rows: DataFrame, config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """By fiscal year: train, validate, test, truncated."""
    return {n: rows.filter(F.col("fiscal_year").isin(*years)) for n, years in config.splits().items()}


def split_name(config: EngineConfig = DEFAULT) -> Column:
    out = F.lit(None).cast("string")
    for name, years in config.splits().items():
        out = F.when(F.col("fiscal_year").isin(*years), name).otherwise(out)
    return out


def precision_at_top_decile(scored: DataFrame, tie: str) -> DataFrame:
    """The share of y among the tenth with the highest scores, one row at least.

    The cut is found first, as the score of that rank, by counts of scores ranked in ranges, so no task ranks all rows or
    scores alone: ties at the cut are taken by the tie column, of the tied rows only.
    """
    n = scored.agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.1)).alias("_n"))
    by = scored.groupBy("p").agg(F.count("*").alias("_m"), F.sum("y").alias("_y"))
    above = _before(by, "_m", descending=True).withColumnRenamed("__m_before", "_before").crossJoin(F.broadcast(n))
    whole = above.filter(F.col("_before") + F.col("_m") <= F.col("_n")).agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("_hit"), F.coalesce(F.sum("_m"), F.lit(0)).alias("_taken"))
    edge = above.filter((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_m") > F.col("_n"))).select(F.col("p").alias("_p"), (F.col("_n") - F.col("_before")).alias("_need"))
    tied = scored.join(F.broadcast(edge), F.col("p") == F.col("_p")).withColumn("_k", F.row_number().over(Window.orderBy(tie))).filter("_k <= _need").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("_more"))
    return whole.crossJoin(tied).crossJoin(n).select(((F.col("_hit") + F.col("_more")) / F.col("_n")).alias("precision_at_top_decile"))


def share_flagged_in_target(scored: DataFrame, threshold: float) -> DataFrame:
    """The share of y at the threshold or above; NULL without any."""
    return scored.agg(F.avg(F.when(F.col("p") >= threshold, F.col("y"))).alias("share_flagged_in_target"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean score and share of y by bins closed on the right; the first takes 0."""
    return scored.groupBy(F.greatest(F.ceil(F.col("p") * bins), F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_predicted"), F.round(F.avg("y"), 4).alias("observed_rate"))


def auc(scored: DataFrame) -> DataFrame:
    """The chance that a positive scores above a negative, ties a half: by counts of distinct scores, ranked in ranges. NULL for one label."""
    by = scored.groupBy("p").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    sums = _before(by, "b").select("a", "b", (F.col("a") * (F.col("_b_before") + F.col("b") / 2)).alias("u")).agg(F.sum("u").alias("u"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("u") / (F.col("a") * F.col("b"))).alias("auc"))


def evaluate(scored: DataFrame, threshold: float, tie: str) -> DataFrame:
    """One row: n, base_rate, auc, brier, precision_at_top_decile, share_flagged_in_target, flagged_share_of_population."""
    basic = scored.agg(F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("base_rate"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 5).alias("brier"), F.round(F.avg(F.when(F.col("p") >= threshold, F.col("y"))), 4).alias("share_flagged_in_target"), F.round(F.avg((F.col("p") >= threshold).cast("int")), 4).alias("flagged_share_of_population"))
    top = precision_at_top_decile(scored, tie).select(F.round("precision_at_top_decile", 4).alias("precision_at_top_decile"))
    return basic.crossJoin(auc(scored).select(F.round("auc", 4).alias("auc"))).crossJoin(top)


def threshold_table(scored: DataFrame) -> DataFrame:
    """For each share to flag its threshold, the rows flagged, recall and precision. Rounded after flagging."""
    cuts = scored.agg(F.percentile("p", F.array(*(F.lit(1 - f) for f in FRACTIONS))).alias("t"))
    # One row of 14 cuts: counted as conditional sums, map-side.
    over = [F.col("p") >= F.get("t", F.lit(k)) for k in range(len(FRACTIONS))]
    sums = [x for k, c in enumerate(over) for x in (F.count_if(c).alias(f"m{k}"), F.coalesce(F.sum(F.when(c, F.col("y"))), F.lit(0)).alias(f"h{k}"))]
    counted = scored.crossJoin(F.broadcast(cuts)).agg(F.first("t").alias("t"), F.sum("y").alias("_pos"), F.count("*").alias("_all"), *sums)
    cells = F.array(*(F.struct(F.lit(f).alias("f"), F.get("t", F.lit(k)).alias("t"), F.col(f"m{k}").alias("m"), F.col(f"h{k}").alias("h")) for k, f in enumerate(FRACTIONS)))
    flagged = counted.select(F.explode(cells).alias("x"), "_pos", "_all").select(F.col("x.f").alias("flag_rate_target"), F.col("x.t").alias("t"), F.col("x.m").alias("flagged"), F.col("x.h").alias("tp"), "_pos", "_all")
    return flagged.select(
        "flag_rate_target",
        F.round("t", 6).alias("threshold"),
        "flagged",
        F.round(F.col("flagged") / F.col("_all") * 100, 2).alias("flagged_pct"),
        F.round(F.col("tp") / F.greatest(F.lit(1), F.col("_pos")), 4).alias("recall"),
        F.round(F.col("tp") / F.greatest(F.lit(1), F.col("flagged")), 4).alias("precision"),
    )


def choose_threshold(table: DataFrame, min_recall: float = 0.90) -> DataFrame:
    """The highest threshold with the recall; the lowest of all if none has it."""
    return table.agg(F.coalesce(F.max(F.when(F.col("recall") >= min_recall, F.col("threshold"))), F.min("threshold")).alias("threshold"))


def band_edges(scored: DataFrame) -> DataFrame:
    return scored.agg(F.percentile("p", F.lit(0.70)).alias("low_edge"), F.percentile("p", F.lit(0.90)).alias("high_edge"))


def band(score: Column, edges: tuple[float, float]) -> Column:
    return F.when(score < edges[0], BANDS[0]).when(score < edges[1], BANDS[1]).when(score.isNotNull(), BANDS[2])


def band_lift(scored: DataFrame, edges: tuple[float, float]) -> DataFrame:
    """Rows, share of y, and its multiple of the whole's, by band."""
    base = scored.agg(F.avg("y").alias("_base"))
    rows = scored.groupBy(band(F.col("p"), edges).alias("band")).agg(F.count("*").alias("n"), F.avg("y").alias("_rate")).crossJoin(F.broadcast(base))
    return rows.select("band", "n", F.round("_rate", 4).alias("positive_rate"), F.round(F.try_divide("_rate", "_base"), 3).alias("lift"))
