"""Point-in-time counts: how many events of a key lie strictly before a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_count(events: DataFrame, queries: DataFrame, key: str, date: str, name: str, lag_days: int = 0, event_key: str | None = None, event_date: str | None = None) -> DataFrame:
    """The queries with the number of events of their key before their date.

    NULL where key or date is; 0 for a key never seen. Events without key or date count nowhere. Both sides are first
    brought to one row a key and day, so the window of a key with any number of events has as many rows as days.
    """
    event_key, event_date = event_key or key, event_date or date
    days = events.select(F.col(event_key).alias("_k"), F.col(event_date).alias("_d")).filter("_k is not null and _d is not null").groupBy("_k", "_d").agg(F.count("*").alias("_n"))
    asked = queries.select(F.col(key).alias("_k"), F.date_add(F.col(date), lag_days).alias("_d")).filter("_k is not null and _d is not null").distinct()
    both = days.unionByName(asked.withColumn("_n", F.lit(0).cast("long"))).groupBy("_k", "_d").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_k").orderBy(F.unix_date("_d")).rangeBetween(Window.unboundedPreceding, -1)
    counts = both.select("_k", "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))
    joined = queries.join(counts, (F.col(key) == F.col("_k")) & (F.date_add(F.col(date), lag_days) == F.col("_d")), "left")
    return joined.drop("_k", "_d")


def earliest(events: DataFrame, key: str, date: str) -> DataFrame:
    """The first day of each key."""
    return events.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key).agg(F.min(date).alias("earliest"))


def distinct_keys(events: DataFrame, key: str, date: str) -> DataFrame:
    """How many keys have an event."""
    return events.filter(F.col(date).isNotNull()).agg(F.count_distinct(key).alias("keys"))
