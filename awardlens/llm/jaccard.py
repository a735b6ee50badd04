"""Exact Jaccard similarity join of word n-grams, with adaptive multi-match prefixes.

A document's set is its distinct shingles of WORDS words (the whole sequence as one, with fewer words). Two documents
link when 100 * intersection >= 80 * union. Documents with equal sets are one class; only classes are compared.

Shingles have one order: by hash, but those frequent in a sample come last, the most frequent at the end. The
l-prefix of a set of n is its first n - ceil(0.8 n) + l shingles. Linked sets share l shingles of their l-prefixes, for
any l up to ceil(0.8 n). Each class takes the l of 1 to LEVELS with the least estimated cost: the entries of its
prefix's lists, and verifying at most a l-th of them; a pair must then share the smaller of both l. The sizes of a pair
tell how much it must share at least, and so how far in either set the first l of that can lie: a shared shingle
beyond is no reason to verify the pair.

The entries of a list of up to LIST are paired among themselves. Of a longer one, star rounds verify each entry against
one leader, which joins near copies to components; while the pairs left between components are many, another
leader is taken. Then all remaining pairs of a list that lie in different components are compared, so no link that
could join two components is missed.

Defined results: null and empty texts have no set, link with nothing, and are their own component; equal doc_ids are
documents of their own, ordered by a hash of the text; a null doc_id is named only if a component has no other;
texts are read whole; an empty table gives an empty table. Only id and text are read, keep_one keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text, components

WORDS = 5
LEVELS = 8
#: The sample that the order is taken from, and how many shingles may come last. Neither changes the result.
SAMPLE, FREQUENT = 16_384, 200_000
#: A list of up to so many entries gives all its pairs; a longer one is settled by stars first.
LIST = 64
#: Tables of up to so many rows of 24 bytes are sent to every executor.
BROADCAST_ROWS = 2_000_000
ROUNDS = 4
#: How much of all documents' sets a step of the verification may send with its pairs.
SHARE = 0.5
SALTS = 16
_FREQUENT_FROM = 1 << 62


def shingles(b: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of the shingles of a chunk's documents, with repetitions, and where each document's begin."""
    h, own = _text.words(b, at, _text.NOT_SPACE)
    n = np.diff(own)
    per = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), per)
    place = own[:-1][doc] + np.arange(out[-1]) - out[doc]
    found = np.zeros(out[-1], np.uint64)
    whole = n[doc] >= words
    full = _text.grams(h, words)
    found[whole] = full[place[whole]]
    for k in range(1, words):
        short = n[doc] == k
        if short.any():
            found[short] = _text.grams(h, k)[place[short]] ^ np.uint64(k)
    return (found >> np.uint64(2)).astype(np.int64), out


def _sets(col: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted sets of each chunk."""
    for i, _, b, at in _text.chunks(col):
        found, own = shingles(b, at, words)
        sets = []
        for s, e in zip(own[:-1], own[1:], strict=True):
            x = np.sort(found[s:e])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
        yield i, sets


def _signature(x: np.ndarray) -> int:
    """A hash of a set: of the sum of its members' hashes and of its size."""
    both = _text.mix(x.astype(np.uint64)).sum(dtype=np.uint64, keepdims=True)
    both ^= _text.mix(np.array([len(x) + 1], np.uint64))
    return int(_text.mix(both).view(np.int64)[0])


class Order:
    """The order of the shingles: a frequent one is renamed to a number above all others."""

    def __init__(self, frequent: list[int]):
        """frequent: from the least to the most frequent."""
        self.known = np.array(sorted(frequent), np.int64)
        rank = {x: k for k, x in enumerate(frequent)}
        self.name = np.array([_FREQUENT_FROM + rank[x] for x in self.known.tolist()], np.int64)

    def sort(self, x: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return x
        k = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        hit = self.known[k] == x
        return np.concatenate([x[~hit], np.sort(self.name[k[hit]])]) if hit.any() else x


def _list(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _prefix(n: Column, level: Column | int = 1) -> Column:
    """n - ceil(0.8 n) + level."""
    return n - F.floor((4 * n + 4) / 5) + level


def _frequent(own: DataFrame, words: int) -> list[int]:
    rows = own.count()
    if not rows:
        return []
    part = F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1 << 30)) / (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column(0), words):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["t"])

    counts = own.filter(part < SAMPLE / rows).select("_t").mapInArrow(run, "t long").groupBy("t").count().filter("count >= 3")
    best = counts.orderBy(F.desc("count"), "t").limit(FREQUENT).collect()
    return [r[0] for r in reversed(best)]


def _near(n1: str, n2: str, l1: str, l2: str, pos1: str, pos2: str) -> Column:
    """Whether a shingle that two sets share may be one of the first l that linked sets of these sizes share.

    They share at least ceil(4 (n1 + n2) / 9), so the first l of those lie before n - that + l in either.
    """
    least = F.floor((4 * (F.col(n1) + F.col(n2)) + 8) / 9)
    level = F.least(l1, l2)
    sizes = 5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)
    return sizes & (F.col(pos1) < F.col(n1) - least + level) & (F.col(pos2) < F.col(n2) - least + level)


def _similar(a: Column, b: Column, shared: Column) -> Column:
    return 100 * shared >= 80 * (a + b - shared)


class Join:
    """The tables of one join; each step is written once and read by the next."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS):
        self.spark, self.words, self.scratch = _store.bounded(docs.sparkSession), words, _store.Scratch("jaccard")
        text = F.col(text_col)
        self.own = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.xxhash64(text).alias("_fp"))
        self._prefixes()

    def kept(self, name: str, table: DataFrame) -> DataFrame:
        return self.scratch.kept(name, table)

    def _small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    def _prefixes(self) -> None:
        """documents: _id, _fp, n, sig, and the longest prefix for the first document of a class in its task."""
        order = self.spark.sparkContext.broadcast(Order(_frequent(self.own, self.words)))
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for i, sets in _sets(batch.column(1), words):
                    sizes, sigs, prefixes = [], [], []
                    for x in sets:
                        n, sig = len(x), _signature(x)
                        first = n > 0 and sig not in seen
                        seen.add(sig)
                        sizes.append(n)
                        sigs.append(sig)
                        prefixes.append(order.value.sort(x)[: n - (4 * n + 4) // 5 + LEVELS] if first else x[:0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), batch.column(2).slice(i, len(sets)), _text.ints(sizes), _text.ints(sigs), _list(prefixes)], names=["_id", "_fp", "n", "sig", "tokens"])

        schema = T.StructType([self.own.schema["_id"]]).add("_fp", "long").add("n", "long").add("sig", "long").add("tokens", T.ArrayType(T.LongType()))
        self.documents = self.kept("prefixes", self.own.select("_id", "_t", "_fp").mapInArrow(run, schema))

    def _lists(self) -> DataFrame:
        """token, sig, n, l and pos: the used prefixes' shingles that more than one class has."""
        once = self.documents.filter(F.size("tokens") > 0)
        rows = once.select("sig", "n", F.posexplode("tokens").alias("pos", "token"))
        # Written before the join, so that the shuffle files of only one of both are on the disks.
        shared = self.kept("shared", rows.groupBy("token").agg(F.count("*").alias("df"), F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo != hi").select("token", "df"))
        hits = self.kept("hits", rows.join(shared, "token").dropDuplicates(["token", "sig"]))
        self.documents = self.kept("documents", self.documents.drop("tokens"))
        self.scratch.drop("prefixes", "shared")
        # Cost of l: S entries to look up, S / l candidates at most, each an eighth of a set to verify.
        need = F.greatest(F.lit(0), F.col("pos") + 1 - _prefix(F.col("n")))
        levels = range(1, LEVELS + 1)
        sums = hits.groupBy("sig").agg(F.first("n").alias("n"), *(F.sum(F.when(need < k, F.col("df") - 1)).alias(f"s{k}") for k in levels))
        cost = [F.when(F.lit(k) <= F.floor((4 * F.col("n") + 4) / 5), F.struct((F.coalesce(F.col(f"s{k}"), F.lit(0)) * (1 + F.col("n") / (8.0 * k))).alias("c"), F.lit(k).alias("l"))) for k in levels]
        chosen = sums.select("sig", F.least(*cost)["l"].alias("l"))
        used = F.least(_prefix(F.col("n"), F.col("l")), F.col("n"))
        lists = self.kept("lists", hits.join(chosen, "sig").filter(F.col("pos") < used).select("token", "sig", "n", "l", "pos"))
        self.scratch.drop("hits")
        return lists

    def _sets_of(self, sigs: DataFrame) -> DataFrame:
        """sig and the sorted set of each of these classes, from a text of each. A row of documents repeated gives another."""
        reps = self.documents.filter("n > 0").join(self._small(sigs), "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("_id", "_fp")).alias("r"))
        reps = self.kept("representatives", reps.select(F.col("r._id").alias("_rid"), F.col("r._fp").alias("_rfp")))
        chosen = self.own.join(self._small(reps), F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_fp") == F.col("_rfp")), "left_semi")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, sets in _sets(batch.column(0), words):
                    yield pa.RecordBatch.from_arrays([_text.ints([_signature(x) for x in sets]), _list(sets)], names=["sig", "set"])

        return self.kept("sets", chosen.select("_t").mapInArrow(run, T.StructType().add("sig", "long").add("set", T.ArrayType(T.LongType()))))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs a, b, a written table, that link, written.

        A join sends a set once a pair. Pairs are dealt to as many steps as keep those sets of a step to a SHARE of all
        documents' sets, so that the disks never hold those of all pairs.
        """
        sets = self._sets_of(self.kept("verified", pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()))
        sent = pairs.join(self._small(sets.select(F.col("sig").alias("a"), F.size("set").alias("m"))), "a").agg(F.sum("m")).first()[0] or 0
        steps = max(1, int(np.ceil(sent / max(1, SHARE * (self.documents.agg(F.sum("n")).first()[0] or 0)))))
        linked = None
        for k in range(steps):
            own = pairs if steps == 1 else pairs.filter(F.pmod(F.xxhash64("a", "b", F.lit(29)), F.lit(steps)) == k)
            both = own.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("sig").alias("b"), F.col("set").alias("sb")), "b")
            # A shuffle of its own for the last step, or it would keep the join's, and a leader's many pairs could not be split.
            part = self.kept("linked", both.filter(_similar(F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb")))).select("a", "b").repartition("a", "b").distinct())
            linked = part if linked is None else linked.unionByName(part)
        self.scratch.drop("verified", "representatives", "sets")
        return linked

    def links(self) -> DataFrame:
        """Links that join the same components as all links do."""
        lists = self._lists()
        sizes = lists.groupBy("token").agg(F.count("*").alias("m"))
        long = self.kept("long-lists", sizes.filter(F.col("m") > LIST).select("token"))
        found, tried = [], None
        entries = lists.withColumn("c", F.col("sig"))
        if long.limit(1).count():
            hot = self.kept("long", lists.join(self._small(long), "token").withColumn("c", F.col("sig")))
            # Classes in long lists take l = 1 from here on: what is left of those lists then are the few entries early
            # enough in their prefixes. A pair goes by the smaller l, so others' pairs with them still need one match.
            marked = self.kept("long-classes", hot.select("sig").distinct().withColumn("hot", F.lit(True)))
            hot, found, tried = self._stars(hot)
            cold = lists.join(self._small(long), "token", "left_anti").join(self._small(marked), "sig", "left")
            cold = cold.withColumn("l", F.when(F.col("hot"), F.lit(1)).otherwise(F.col("l"))).drop("hot").withColumn("c", F.col("sig"))
            # The entries of long lists know their components; of the others each is its own.
            entries = cold.unionByName(hot.withColumn("l", F.lit(1)))
        rest = self._verify(self._rest(entries, tried))
        for table in found:
            rest = rest.unionByName(table)
        return self.kept("links", rest)

    def _stars(self, hot: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
        """Rounds over the long lists: their entries with components, the links, and the pairs that were verified."""
        found: list[DataFrame] = []
        tried, share = None, 1.0
        for k in range(ROUNDS):
            # Pairs left between components that share a list: the square of its entries less those of its components.
            by = hot.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"))
            left, entries = by.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.sum("m")).first()
            if tried is not None and (left <= LIST / 2 * entries or share < 0.1):
                break
            # Those of about one size have a leader, first the one with the fewest rarer shingles, as an original has
            # among its edited copies, then the least by a hash of the round; least values combine map-side.
            band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.25))) + k % 2 / 2).cast("long")
            banded = hot.withColumn("band", band)
            leaders = banded.groupBy("token", "band").agg(F.min(F.struct((F.col("pos") if k == 0 else F.lit(0)).alias("first"), F.xxhash64("sig", F.lit(k)).alias("h"), F.col("sig").alias("leader"), F.col("c").alias("lc"), F.col("n").alias("ln"), F.col("l").alias("ll"), F.col("pos").alias("lpos"))).alias("x")).select("token", "band", "x.*")
            able = _near("n", "ln", "l", "ll", "pos", "lpos")
            pairs = banded.join(leaders, ["token", "band"]).filter((F.col("c") != F.col("lc")) & able)
            pairs = pairs.select(F.least("sig", "leader").alias("a"), F.greatest("sig", "leader").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = self.kept("star-pairs", pairs)
            tried = pairs if tried is None else tried.unionByName(pairs)
            found.append(self._verify(pairs))
            share = found[-1].count() / max(1, pairs.count())
            links = found[0]
            for table in found[1:]:
                links = links.unionByName(table)
            labels = components.connected(links)
            hot = self.kept("labelled", hot.drop("c").join(self._small(labels.withColumnRenamed("node", "sig")), "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component"))
        return hot, found, tried

    def _rest(self, labelled: DataFrame, tried: DataFrame | None) -> DataFrame:
        """All pairs of different components that share enough of their prefixes."""
        one = labelled.select("token", *(F.col(x).alias(f"{x}1") for x in ("sig", "n", "l", "pos", "c")))
        two = labelled.select("token", *(F.col(x).alias(f"{x}2") for x in ("sig", "n", "l", "pos", "c")))
        able = (F.col("sig1") < F.col("sig2")) & (F.col("c1") != F.col("c2")) & _near("n1", "n2", "l1", "l2", "pos1", "pos2")
        pairs = one.join(two, "token").filter(able).groupBy(F.col("sig1").alias("a"), F.col("sig2").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("l1", "l2")).alias("l"))
        # Pairs that share a long list within a component count less than they share, and may be dropped: they are joined.
        pairs = pairs.filter(F.col("shared") >= F.col("l")).select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        return self.kept("rest-pairs", pairs)

    def classes(self) -> DataFrame:
        """doc_id, fp, n_shingles, component_id and whether the document is the first of its component, for every document."""
        labels = components.connected(self.links()).withColumnRenamed("node", "sig")
        firsts = self.documents.filter("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_fp").alias("fp"))).alias("r"))
        named = firsts.join(labels, "sig", "left")
        # A component's classes are dealt to SALTS parts; a class without links is its own component and joins nothing.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        least = named.filter("component is not null").groupBy("component").agg(F.min("r").alias("least")).select("component", "least", salts)
        named = named.withColumn("component", F.coalesce("component", "sig")).withColumn("salt", F.pmod("sig", F.lit(SALTS)).cast("int"))
        named = self.kept("classes", named.join(least, ["component", "salt"], "left").select("sig", F.coalesce("least", "r").alias("least")))
        self.scratch.drop(but=("documents", "classes"))
        out = self.documents.select("_id", "_fp", "n", "sig").join(named, "sig", "left")
        first = F.col("_id").eqNullSafe(F.col("least.id")) & (F.col("_fp") == F.col("least.fp"))
        alone = F.col("n") == 0
        return out.select(F.col("_id").alias("doc_id"), F.col("_fp").alias("fp"), F.col("n").alias("n_shingles"), F.when(alone, F.col("_id")).otherwise(F.col("least.id")).alias("component_id"), (alone | first).alias("first"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return Join(docs, **options).classes().drop("fp", "first")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of each component, with all its columns; of rows alike in id and text one stays.

    Documents without words link with nothing and all stay.
    """
    join = Join(docs, id_col, text_col, **options)
    facts = join.kept("decisions", join.classes().groupBy("doc_id", "fp").agg(F.max("first").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")).filter("not first or (rows > 1 and n > 0)"))
    join.scratch.drop(but=("decisions",))
    mine = docs.select(_store.row_of(docs), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"))

    def match(table: DataFrame, how: str) -> DataFrame:
        table = join._small(table.select(F.col("doc_id").alias("id2"), F.col("fp").alias("fp2")))
        return mine.join(table, F.col("id").eqNullSafe(F.col("id2")) & (F.col("fp") == F.col("fp2")), how)

    single = match(facts, "left_anti").select("row.*")
    repeated = facts.filter("first")
    if repeated.limit(1).count() == 0:
        return single
    return single.unionByName(match(repeated, "left_semi").dropDuplicates(["id", "fp"]).select("row.*"))
