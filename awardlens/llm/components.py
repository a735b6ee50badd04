"""Connected components of a table of links, by the least label among neighbours and pointer jumping.

Each step is joins and map-side combined minima on a written table, so a node with any number of links is no single
task's group, and nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def connected(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """node and component (the component's least node) of every node with a link."""
    scratch = _store.Scratch("components")

    def kept(table: DataFrame, step: str = "edges") -> DataFrame:
        return scratch.kept(step, table)

    one = links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = kept(one.union(one.select("v", "u")).distinct())
    labels = kept(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels-0")
    for k in range(most_rounds):
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("c").alias("nc")), "v").groupBy("u").agg(F.min("nc").alias("nc"))
        lower = labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "nc").alias("c"))
        # The label is a node too: take its label, if that is less.
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        new = kept(lower.join(jump, "c", "left").select("u", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), f"labels-{k + 1}")
        labels = new.select("u", "c")
        scratch.drop(f"labels-{k}")
        if new.filter("old != c").limit(1).count() == 0:
            scratch.drop("edges")
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise RuntimeError(f"the components aren't found after {most_rounds} rounds")
