"""Mixing sources to target weights: temperature, then budgeted block permutations.

Source s with the share p_s of all tokens gets the weight p_s^a / sum p_t^a. The exponent a in [0, 1] is bisected:
the largest with an entropy of at least ``entropy`` x ln(sources), or, if that would read a source more than
``repeats`` times, the least that doesn't. Without a budget the mixture is as long as needed for every source to
be read whole at least once.

A source's stream is one permutation of its documents after another, by a hash of the seed, the epoch and the
document, until its budget (weight x total) is spent; the document that reaches it is the last. Blocks take
weight x ``block_tokens`` tokens from each stream, and a block's documents are permuted again.

Nothing but DataFrame functions. Prefix sums over a source are split by the first hex digits of the hash, with
about ROWS_A_BUCKET documents each, so a source with a third of all rows is as many tasks as it needs. Sums over
sources run as aggregates; the driver sees a few numbers for each step of the bisection.

Documents are identified by (id, source, text): rows alike in these are one unit, given together. Defined results: a
null source is a source of its own; null and empty texts have no tokens and ride along in their permutation; a source
without tokens has weight 0 and is given once, BLOCK_ROWS documents a block from the first on; an empty table gives empty
results. Other columns, of any names, are kept by realise and not read by plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store

ENTROPY = 0.97
REPEATS = 2.0
BLOCK_TOKENS = 65_536
SEED = 17
STEPS = 32
ROWS_A_BUCKET = 4096
BROADCAST_SOURCES = 500_000
#: Documents a block of a source without tokens.
BLOCK_ROWS = 4096
_LEVELS = 4


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), lambda w: w != "")).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def unit_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text.cast("binary")), F.lit("-")))


def _order(seed: int, epoch: Column, unit: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), unit).cast("binary"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, unit, doc_id, copies, tokens: a row for each document; copies' tokens count each."""
    own = docs.select(source_key(F.col(source_col)).alias("source"), unit_key(F.col(id_col), F.col(text_col)).alias("unit"), F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col)).alias("tokens"))
    return own.groupBy("source", "unit").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))


@dataclass(frozen=True)
class Totals:
    """What the bisection needs of an exponent: sums over the sources' shares."""

    n: int
    total: int
    least: float
    most: float


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """sum p^a and sum p^a ln p for each exponent, in one pass."""
    cells = [x for k, a in enumerate(exponents) for x in (F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"l{k}"))]
    row = shares.agg(*cells).first()
    return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(exponents))]


def _bisect(shares: DataFrame, steps: int, holds) -> float:
    """The last exponent known to hold when [0, 1] was halved steps times; holds(a, sums) is true at 0 and false from some point on."""
    lo, hi = 0.0, 1.0
    while steps:
        levels = min(_LEVELS, steps)
        steps -= levels
        # All midpoints that the next levels may ask for.
        grid = [lo + (hi - lo) * k / (1 << levels) for k in range(1, 1 << levels)]
        known = dict(zip(grid, _sums(shares, grid), strict=True))
        for _ in range(levels):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid, known[mid]) else (lo, mid)
    return lo


def exponent(shares: DataFrame, facts: Totals, entropy: float = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, steps: int = STEPS) -> float:
    """The temperature's exponent for a table of shares p of sources with tokens."""
    goal = entropy * math.log(facts.n)

    def entropy_of(a: float, s: tuple[float, float]) -> float:
        return math.log(s[0]) - a * s[1] / s[0]

    def repeated(a: float, s: tuple[float, float]) -> float:
        if budget is None:
            return (facts.most / facts.least) ** (1 - a)
        return facts.least ** (a - 1) / s[0] * budget / facts.total

    (one,) = _sums(shares, [1.0])
    found = 1.0 if entropy_of(1.0, one) >= goal else _bisect(shares, steps, lambda a, s: entropy_of(a, s) >= goal)
    if repeats is not None:
        at = _sums(shares, [found])[0]
        if repeated(found, at) > repeats:
            if repeated(1.0, one) > repeats:
                return 1.0
            found = _bisect(shares, steps, lambda a, s: repeated(a, s) > repeats) + 2.0**-steps
    return found


def _weights(sources: DataFrame, budget: int | None, block_tokens: int, **options) -> DataFrame:
    """For each source its tokens, rows, weight, budget, epochs and tokens of a block."""
    facts = sources.filter("t > 0").agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    if not facts[0]:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(0).cast("long").alias("whole"), F.lit(1).cast("long").alias("epochs"), F.lit(int(block_tokens)).cast("long").alias("quota"))
    n, total = int(facts[0]), int(facts[1])
    known = Totals(n, total, facts[2] / total, facts[3] / total)
    shares = sources.filter("t > 0").select((F.col("t") / F.lit(float(total))).alias("p"))
    a = exponent(shares, known, budget=budget, **options)
    ((z, _),) = _sums(shares, [a])
    # Without a budget, the source with the largest p / weight, the largest one, is read once.
    size = float(budget) if budget is not None else float(total) * known.most / (known.most**a / z)
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    spent = F.greatest(F.round(F.col("weight") * F.lit(size), 0).cast("long"), F.lit(1))
    out = sources.withColumn("weight", weight)
    out = out.withColumn("budget", F.when(F.col("t") > 0, spent).otherwise(F.lit(0)))
    whole = F.expr("if(t > 0, budget div greatest(t, 1), 0)")
    epochs = F.when(F.col("t") > 0, F.col("whole") + (F.col("budget") > F.col("whole") * F.col("t")).cast("long")).otherwise(F.lit(1)).cast("long")
    quota = F.greatest(F.round(F.col("weight") * F.lit(float(block_tokens)), 0).cast("long"), F.lit(1))
    return out.withColumn("whole", whole).withColumn("epochs", epochs).withColumn("quota", quota)


def _small(table: DataFrame) -> DataFrame:
    """A table of sources, sent to every executor if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def weights(docs: DataFrame, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> tuple[DataFrame, DataFrame]:
    """The units, and for each source its weight, budget, epochs and tokens of a block; both are written tables."""
    own = _store.kept(units(docs, id_col, text_col, source_col), "mixing-units")
    # Read by every step of the bisection, so it is written first.
    totals = _store.kept(own.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("rows")), "mixing-totals")
    return own, _store.kept(_weights(totals, budget, block_tokens, **options), "mixing-sources")


def _streams(own: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """A row for each unit and epoch, with the tokens of its stream before it, its block, and its order there."""
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("rows") / F.lit(float(ROWS_A_BUCKET))) / F.lit(math.log(16.0)))).cast("int")
    rows = own.join(_small(sources.withColumn("digits", digits)), "source")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    rows = rows.withColumn("h", _order(seed, F.col("epoch"), F.col("unit")))
    rows = rows.withColumn("bucket", F.substring("h", F.lit(1), F.col("digits")))
    # Without tokens, documents are counted instead.
    rows = rows.withColumn("size", F.when(F.col("t") > 0, F.col("tokens")).otherwise(1).cast("long"))
    keys = ["source", "epoch", "bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("source", "epoch").orderBy("bucket")
    sums = sums.select(*keys, (F.sum("_s").over(before) - F.col("_s")).alias("_base"))
    within = Window.partitionBy(*keys).orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_own", F.sum("size").over(within) - F.col("size")).join(sums, keys)
    place = F.col("_base") + F.col("_own")
    rows = rows.withColumn("start", F.when(F.col("t") > 0, F.col("epoch") * F.col("t") + place).otherwise(0).cast("long"))
    rows = rows.withColumn("block", F.when(F.col("t") > 0, F.floor(F.col("start") / F.col("quota"))).otherwise(F.floor(place / F.lit(BLOCK_ROWS))).cast("long"))
    rows = rows.withColumn("again", F.md5(F.concat_ws("|", F.lit(f"{seed}b"), F.col("epoch").cast("string"), F.col("source"), F.col("unit")).cast("binary")))
    return rows.filter((F.col("epoch") < F.col("whole")) | (F.col("start") < F.col("budget")) | (F.col("t") == 0))


#: The order of a block's rows.
_WITHIN = ["again", "source", "unit", "epoch"]


def plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixture: doc_id, source, epoch, start in the source's stream, tokens, copies, block and position in the block."""
    rows = _streams(*weights(docs, **options), seed)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("block").orderBy(*_WITHIN)).cast("long"))
    return rows.select("doc_id", F.when(F.col("source") == "-", F.lit(None)).otherwise(F.expr("substring(source, 2)")).alias("source"), "epoch", "start", "tokens", "copies", "block", "position")


def realise(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture's documents with all their columns, in order of block and position: written, the files have this order.

    A document's rows in the mixture are few (its epochs); they meet its text by unit, and the texts are sorted by block.
    """
    streams = _streams(*weights(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options), seed).select("block", *_WITHIN)
    streams = _store.kept(streams, "mixing-order")
    mine = docs.select(_store.row_of(docs), source_key(F.col(f"`{source_col}`")).alias("source"), unit_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("unit"))
    order = ["block", *_WITHIN]
    return mine.join(streams, ["unit", "source"]).repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
