"""Benchmarks: for each peer group and month, what had been signed strictly before the month."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from ..functions.calendar import month_number

#: Ranges of amounts for each doubling.
BUCKETS = 8
#: Stands for the month of contracts without one, which comes last.
UNDATED = 2**31 - 1
LADDERS = {"category_region": ("procurement_category", "region"), "category": ("procurement_category",), "overall": (), "practice": ("global_practice",)}


def build(contracts: DataFrame, keys: tuple[str, ...], config: EngineConfig = DEFAULT, approximate: bool = False, unknown: bool = False) -> DataFrame:
    """keys, m, median, support_n and the sketch of each month in which the group has a contract.

    Quantiles are exact and no group is one task: amounts are dealt to ranges (BUCKETS for each doubling), a group's counts
    by range and month say in which range each quantile of each month's growing prefix lies and at which place there, and
    each range finds its places. Groups with a null key have no benchmark.

    unknown: as the SQL has it, groups with a null key have one too, and contracts without a month have a cell each group, of
    all its contracts. No contract finds these by lookup.

    approximate: each month is a KLL sketch, made map-side, and a window merges one sketch a month; ranks are then within
    about one in a hundred.
    """
    points = [k / (config.sketch_points - 1) for k in range(config.sketch_points)]
    rows = contracts.select(*keys, month_number("signing_date").alias("m"), "amount_usd")
    if unknown:
        rows = rows.withColumn("m", F.coalesce("m", F.lit(UNDATED)))
    elif keys:
        rows = rows.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    if approximate:
        before = Window.partitionBy(*keys).orderBy("m").rangeBetween(Window.unboundedPreceding, -1)
        months = rows.groupBy(*keys, "m").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("amount_usd", F.lit(800)).alias("k"))
        cells = months.select(*keys, "m", F.sum("n").over(before).alias("support_n"), F.kll_merge_agg_double("k").over(before).alias("k")).filter(F.col("support_n") >= config.min_group_support)
        cells = cells.select(*keys, "m", "support_n", F.kll_sketch_get_quantile_double("k", F.array(*map(F.lit, points))).alias("sketch"))
    else:
        cells = _exact(rows, keys, points, config)
    if unknown:
        cells = cells.withColumn("m", F.when(F.col("m") != UNDATED, F.col("m")))
    return cells.select(*keys, "m", F.get("sketch", F.lit((config.sketch_points - 1) // 2)).alias("median"), "support_n", "sketch")


def _exact(rows: DataFrame, keys: tuple[str, ...], points: list[float], config: EngineConfig) -> DataFrame:
    """keys, m, support_n and sketch. Amounts are positive."""
    group = ["_g", *keys]
    counted = rows.groupBy(*keys, "m", "amount_usd").agg(F.count("*").alias("n")).filter("m is not null").withColumns({"_g": F.lit(0), "_b": F.least(F.floor(F.log2("amount_usd") * BUCKETS), F.lit(2**31 - 1)).cast("int")})
    own = T.StructType([counted.schema[k] for k in group])
    share, least = np.array(points), config.min_group_support

    def places(table: pd.DataFrame) -> pd.DataFrame:
        """Of one group's counts by range and month: for each month and range the quantiles there (2 k, 2 k + 1 for the values below and above point k), and their places."""
        bucket, b = np.unique(table["_b"].to_numpy(), return_inverse=True)
        month, m = np.unique(table["m"].to_numpy(), return_inverse=True)
        grid = np.zeros((len(bucket), len(month) + 1), np.int64)
        np.add.at(grid, (b, m + 1), table["n"].to_numpy())
        total = np.cumsum(grid, axis=1)
        if month[-1] == UNDATED:
            total[:, -2] = total[:, -1]  # contracts without a month are counted in their own cell
        top = np.cumsum(total[:, :-1], axis=0)  # of earlier months, up to each range
        out = []
        for j in np.flatnonzero(top[-1] >= max(least, 1)):
            place = share * (top[-1, j] - 1)
            rank = np.stack([np.floor(place), np.ceil(place)], axis=1).astype(np.int64).ravel()
            at = np.searchsorted(top[:, j], rank, side="right")
            rank -= np.where(at > 0, top[at - 1, j], 0)
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            for s, e in zip(cut, [*cut[1:], len(at)], strict=True):
                out.append((int(bucket[at[s]]), int(month[j]), int(top[-1, j]), list(range(s, e)), rank[s:e].tolist()))
        found = pd.DataFrame(out, columns=["_b", "m", "support_n", "ks", "ranks"])
        for k in group:
            found.insert(0, k, table[k].iloc[0])
        return found

    def values(table: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """The amounts at the wanted places of one range."""
        table = table.sort_values("amount_usd")
        amount, month, n = (table[c].to_numpy() for c in ("amount_usd", "m", "n"))
        found = [amount[np.searchsorted(np.cumsum(np.where((month < m) | (m == UNDATED), n, 0)), np.asarray(r), side="right")].tolist() for m, r in zip(wanted["m"], wanted["ranks"], strict=True)]
        return wanted[[*group, "m", "support_n", "ks"]].assign(vs=pd.Series(found, index=wanted.index, dtype=object))

    asked = T.StructType([*own.fields]).add("_b", T.IntegerType()).add("m", T.IntegerType()).add("support_n", "long").add("ks", T.ArrayType(T.IntegerType())).add("ranks", T.ArrayType(T.LongType()))
    wanted = counted.groupBy(*group, "_b", "m").agg(F.sum("n").alias("n")).groupBy(*group).applyInPandas(places, asked)
    told = T.StructType([*own.fields]).add("m", T.IntegerType()).add("support_n", "long").add("ks", T.ArrayType(T.IntegerType())).add("vs", T.ArrayType(T.DoubleType()))
    parts = counted.groupBy(*group, "_b").cogroup(wanted.groupBy(*group, "_b")).applyInPandas(values, told)
    cells = parts.groupBy(*keys, "m").agg(F.first("support_n").alias("support_n"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("ks", "vs"))))["vs"].alias("vs"))

    def product_plus(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """a * b + c, rounded once: the product and the sum are split into their value and what it lacks."""

        def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = x * 134217729.0  # 2 ** 27 + 1
            top = top - (top - x)
            return top, x - top

        with np.errstate(over="ignore", invalid="ignore"):
            product = a * b
            (a1, a2), (b1, b2) = halves(a), halves(b)
            lost = ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2
            total = product + c
            own = total - product
            exact = total + (((product - (total - own)) + (c - own)) + lost)
        return np.where(np.isfinite(exact), exact, total)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def between(vs: pd.Series, support: pd.Series) -> pd.Series:
        """The quantiles, of the values below and above each place, in the steps and roundings that the SQL's engine has."""
        found = []
        for v, n in zip(vs, support, strict=True):
            low, high, place = np.asarray(v[0::2]), np.asarray(v[1::2]), share * (n - 1)
            part = place - np.floor(place)
            found.append(np.where(part == 0, low, product_plus(low, 1 - part, high * part)))
        return pd.Series(found, index=vs.index, dtype=object)

    return cells.withColumn("sketch", between("vs", "support_n"))


def percentile_of(amount: Column | str, sketch: Column | str) -> Column:
    """How many points of the sketch the amount reaches."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.size(F.filter(sketch, lambda q: q <= amount))


def lookup(rows: DataFrame, cells: DataFrame, keys: tuple[str, ...], prefix: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """The group's cell in the row's month _m, in columns with the prefix; nulls where there is none.

    With lookup "asof", the latest cell up to that month.
    """
    fields = ("median", "support_n", "sketch")
    if config.lookup == "asof":
        wanted = rows.select(*keys, F.col("_m").alias("m")).distinct().withColumn("asked", F.lit(True))
        both = wanted.unionByName(cells.withColumn("asked", F.lit(False)), allowMissingColumns=True)
        past = Window.partitionBy(*keys).orderBy("m", F.col("asked").asc()).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({f: F.last(f, ignorenulls=True).over(past) for f in fields})
        cells = both.filter("asked and support_n is not null").drop("asked")
    named = cells.select(*(F.col(k).alias(f"_{prefix}_{k}") for k in keys), F.col("m").alias(f"_{prefix}_m"), *(F.col(f).alias(f"{prefix}_{f}") for f in fields))
    on = [F.col(k) == F.col(f"_{prefix}_{k}") for k in keys] + [F.col("_m") == F.col(f"_{prefix}_m")]
    return rows.join(named, on, "left").drop(f"_{prefix}_m", *(f"_{prefix}_{k}" for k in keys))
