"""Benchmark decontamination with suffix arrays over shards of the training text.

``shards`` cuts the documents into shards of about SHARD bytes, whole documents each, and writes for each the numbers of
its words, its vocabulary, and the array of all its word suffixes, sorted by their first words (a window's at least).
Every test suffix is binary-searched in the array of every shard: first by its leading words in one go, then, where
these occur, by the rest. Hits give the places in the documents; runs of neighbouring hits give the longest verbatim
matches. Nothing is shuffled, and the arrays are built once for any number of parts of the benchmark.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z, told apart by 64-bit hashes. A window is WINDOW
consecutive words of an item; an item with fewer words, but not none, is one window. Numbers follow the order of a
shard's hashes, so an array is in an order of its own, which searching doesn't mind.

The benchmark goes to every executor. Its size is summed up first: more than ``max_bytes`` goes in as many parts, one
after the other, and each document's intervals and items of all parts are joined, so the results don't depend on it.

Defined results: a null or empty text has no words and no hits; a null text of an item gives no window; a null
item_id counts as an item named by the empty string; repeated items with one id count once; repeated documents
get a row each; an empty benchmark contaminates nothing; an empty table gives an empty table. Only the id and the
text column are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

WINDOW = 10
MAX_BYTES = 32 << 20
SHARD = 1 << 21


class Index:
    """Windows of the benchmark, as distinct word patterns with the items that have them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        names, texts = [x[0] for x in items], pa.array([x[1] for x in items], pa.string())
        h, at = [], [np.zeros(1, np.int64)]
        for _, _, b, offsets in _text.chunks(texts):
            hashes, own = _text.words(b, offsets, _text.ALNUM)
            h.append(hashes)
            at.append(own[1:] + at[-1][-1])
        words, at = np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate(at)
        self.names = np.array(["" if x is None else str(x) for x in names], object)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        n = np.diff(at)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(n)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n, window)[item]
        cells = at[item][:, None] + place[:, None] + np.arange(window)
        pattern = np.where(np.arange(window) < length[:, None], number[np.minimum(cells, max(len(number) - 1, 0))] + 1 if len(number) else 0, 0).astype(np.uint32)
        self.patterns, which = np.unique(pattern, axis=0, return_inverse=True) if len(pattern) else (pattern, item)
        which = np.asarray(which).reshape(-1)
        self.length = np.zeros(len(self.patterns), np.int64)
        self.length[which] = length
        order = np.lexsort((place, item, which))
        self.item, self.place = item[order], place[order]
        self.at = np.searchsorted(which[order], np.arange(len(self.patterns) + 1))


def _packed(number: np.ndarray, left: np.ndarray, width: int, per: int) -> np.ndarray:
    """The numbers of per neighbouring words from each place as one; 0 past the document's end."""
    out = np.zeros(len(number), np.uint64)
    for k in range(per):
        out <<= np.uint64(width)
        out[: len(number) - k] |= np.where(left[: len(number) - k] > k, number[k:], 0).astype(np.uint64) if k < len(number) else np.uint64(0)
    return out


@dataclass
class Shard:
    """Some documents' words and the array of their suffixes.

    own: where each document's words begin; number: each word's number in the vocabulary, from 1; array: all places, in
    the order of the words from there on, at least ``depth`` of them.
    """

    own: np.ndarray
    vocabulary: np.ndarray
    number: np.ndarray
    array: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, own: np.ndarray, depth: int = WINDOW) -> Shard:
        vocabulary, number = np.unique(words, return_inverse=True)
        out = cls(own, vocabulary, (number + 1).astype(np.int32), np.zeros(0, np.int32))
        width, per, left = out.layout()
        # Prefix doubling: ranks by a number of words, paired with the ranks of as many words on, rank twice as many.
        key = _packed(out.number, left, width, per)
        while True:
            order = np.argsort(key)
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            if per >= depth or new.all():
                break
            rank = np.empty(len(key), np.uint64)
            rank[order] = np.cumsum(new)
            key = rank << np.uint64(32)
            if per < len(key):
                key[:-per] |= np.where(left[:-per] > per, rank[per:], 0).astype(np.uint64)
            per *= 2
        out.array = order.astype(np.int32)
        return out

    def layout(self) -> tuple[int, int, np.ndarray]:
        """Bits of a word's number, how many go into 64, and how many words each document has from each place on."""
        width = max(1, int(len(self.vocabulary)).bit_length())
        left = np.repeat(self.own[1:], np.diff(self.own)) - np.arange(len(self.number))
        return width, 64 // width, left

    def search(self, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the index's windows: document, place in it, and pattern."""
        empty = np.zeros(0, np.int64)
        if not len(self.number) or not len(index.patterns):
            return empty, empty, empty
        # The index's words in this shard's numbers; a window with another word can't occur.
        near = np.minimum(np.searchsorted(self.vocabulary, index.vocabulary), len(self.vocabulary) - 1)
        known = np.concatenate([[0], np.where(self.vocabulary[near] == index.vocabulary, near + 1, -1)])
        pattern = known[index.patterns]
        able = np.flatnonzero((pattern >= 0).all(axis=1))
        pattern, length = pattern[able], index.length[able]
        width, per, left = self.layout()
        lead = _packed(self.number, left, width, per)[self.array]
        low, high = np.zeros((2, len(able)), np.uint64)
        for k in range(per):
            cell = pattern[:, k].astype(np.uint64) if k < index.window else np.zeros(len(able), np.uint64)
            open_ = length <= k  # the window is over: any word may follow
            low = (low << np.uint64(width)) | np.where(open_, np.uint64(0), cell)
            high = (high << np.uint64(width)) | np.where(open_, np.uint64((1 << width) - 1), cell)
        first, last = np.searchsorted(lead, low, "left"), np.searchsorted(lead, high, "right")
        there = np.flatnonzero(first < last)
        first, last, able, pattern, length = first[there], last[there], able[there], pattern[there], length[there]
        if per < index.window and len(able):
            first, last = (self._bisect(pattern, length, left, per, first, last, after) for after in (False, True))
        count = np.maximum(last - first, 0)
        at = self.array[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())].astype(np.int64)
        doc = np.searchsorted(self.own, at, side="right") - 1
        return doc, at - self.own[doc], np.repeat(able, count)

    def _bisect(self, pattern: np.ndarray, length: np.ndarray, left: np.ndarray, begin: int, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        """Within lo..hi of the array, where the suffixes that aren't less than the pattern begin, or end if after."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, len(self.array) - 1)
            place = self.array[mid].astype(np.int64)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k in range(begin, pattern.shape[1]):
                x = np.where(left[place] > k, self.number[np.minimum(place + k, len(self.number) - 1)], 0)
                counts = same & (length > k)
                less |= counts & (x < pattern[:, k])
                same &= ~counts | (x == pattern[:, k])
            go, open_ = less | same if after else less, lo < hi
            lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo


def _pieces(texts: pa.Array, window: int) -> Iterator[tuple[int, int, Shard]]:
    """First document, document after the last, and the shard of each piece of a batch.

    A shard's words are hashed a chunk at a time, as that takes far more memory than the words.
    """
    first, size, parts, borders = 0, 0, [], [np.zeros(1, np.int64)]
    for i, j, b, at in _text.chunks(texts):
        if size and size + len(b) > SHARD:
            yield first, i, Shard.of(np.concatenate(parts), np.concatenate(borders), window)
            first, size, parts, borders = i, 0, [], [np.zeros(1, np.int64)]
        h, own = _text.words(b, at, _text.ALNUM)
        parts.append(h)
        borders.append(borders[-1][-1] + own[1:])
        size += len(b)
    if parts:
        yield first, len(texts), Shard.of(np.concatenate(parts), np.concatenate(borders), window)


_SCHEMA = "shard long, ids array<{}>, own binary, vocabulary binary, number binary, suffixes binary"
_KINDS = {"own": np.int64, "vocabulary": np.uint64, "number": np.int32, "suffixes": np.int32}


def shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Write the documents' suffix arrays as a Parquet table at path, on storage that all executors share, and read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, x in _pieces(batch.column(1), window):
                cells = [v.tobytes() for v in (x.own.astype(np.int64), x.vocabulary, x.number, x.array)]
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([_text.ints([number]), ids, *(pa.array([c], pa.binary()) for c in cells)], names=["shard", "ids", *_KINDS])
                number += 1

    schema = _SCHEMA.format(docs.schema[id_col].dataType.simpleString())
    _store.bounded(docs.sparkSession)
    return _store.write(docs.select(id_col, text_col).mapInArrow(run, schema), path)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, Shard]]:
    """Number, document ids and content of the shards of a batch of the written table."""
    for k in range(len(batch)):
        cells = [np.frombuffer(batch.column(2 + c)[k].as_buffer(), kind) for c, kind in enumerate(_KINDS.values())]
        yield batch.column(0)[k].as_py(), batch.column(1).slice(k, 1).flatten(), Shard(*cells)


def _intervals(index: Index, doc: np.ndarray, place: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words inside any occurrence, as joined intervals in order of document and place."""
    order = np.lexsort((place, doc))
    doc, s = doc[order], place[order]
    e = s + index.length[pattern[order]]
    top = np.maximum.accumulate(e + doc * (1 << 40)) - doc * (1 << 40) if len(e) else e
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > top[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], top[np.append(first[1:], len(doc))[: len(first)] - 1]


def _expand(index: Index, doc: np.ndarray, place: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place there, item and place there, for each occurrence and each item that has its window."""
    count = np.diff(index.at)[pattern]
    at = np.repeat(index.at[pattern], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), np.repeat(place, count), index.item[at], index.place[at]


def _matches(index: Index, doc: np.ndarray, place: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches that can't be lengthened: document, item, first word in either, and number of words."""
    size = np.repeat(index.length[pattern], np.diff(index.at)[pattern])
    doc, place, item, other = _expand(index, doc, place, pattern)
    order = np.lexsort((place, place - other, item, doc))
    doc, place, item, other, size = doc[order], place[order], item[order], other[order], size[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (other[1:] != other[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], item[first], place[first], other[first], place[last] + size[last] - place[first]


def _items(index: Index, doc: np.ndarray, pattern: np.ndarray) -> dict[int, list[str]]:
    pairs = np.unique(np.stack([doc, pattern]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    out: dict[int, set[str]] = {}
    for d, p in pairs.T.tolist():
        out.setdefault(d, set()).update(index.names[index.item[index.at[p] : index.at[p + 1]]])
    return {d: sorted(x) for d, x in out.items()}


def prepare(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> Iterator:
    """The index of each part of the benchmark, one at a time, as a broadcast variable; a part has about max_bytes at most."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    size, n = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-(size + 64 * n) // max_bytes))
    context = _store.bounded(benchmark.sparkSession).sparkContext
    for k in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield context.broadcast(Index([tuple(r) for r in own.collect()], window))


def _found(table: DataFrame, index, kind: str, every: bool) -> DataFrame:
    """What a part of the benchmark finds in written shards: a row for each document, or for those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, shard in _read(batch):
                found = shard.search(index.value)
                doc, s, e = _intervals(index.value, *found)
                items, longest = _items(index.value, found[0], found[2]), np.zeros(len(ids), np.int64)
                match = _matches(index.value, *found)
                np.maximum.at(longest, match[0], match[4])
                own = np.arange(len(ids)) if every else np.unique(doc)
                cut, flat = np.searchsorted(doc, own), np.stack([s, e], axis=1)
                ends = np.searchsorted(doc, own, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        _text.ints(np.full(len(own), number)),
                        _text.ints(own),
                        ids.take(pa.array(own)),
                        _text.ints(np.diff(shard.own)[own]),
                        pa.array([flat[x:y].ravel().tolist() for x, y in zip(cut, ends, strict=True)], pa.list_(pa.int64())),
                        pa.array([items.get(d, []) for d in own.tolist()], pa.list_(pa.string())),
                        _text.ints(longest[own]),
                    ],
                    names=["shard", "row", "doc_id", "n_words", "spans", "items", "longest"],
                )

    return table.mapInArrow(run, f"shard long, row long, doc_id {kind}, n_words long, spans array<bigint>, items array<string>, longest long")


def _covered(spans: list[int]) -> int:
    """How many numbers lie in intervals s, e, s, e, ... that may overlap."""
    total, top = 0, 0
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total, top = total + max(0, e - max(s, top)), max(top, e)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """For each document its words, the words inside occurrences, the items these belong to, and its longest match's words."""
    scratch = _store.Scratch("decontaminate")
    kind = docs.schema[id_col].dataType.simpleString()
    table = shards(docs, _store.place(docs.sparkSession, "suffix-arrays"), id_col, text_col, window)
    parts = prepare(benchmark, window=window, **options)
    rows, more = _found(table, next(parts), kind, True), 0
    for index in parts:
        # As many rows for a document as there are parts, each of a written table.
        rows = (scratch.kept(f"part-{more}", rows) if not more else rows).unionByName(scratch.kept(f"part-{more + 1}", _found(table, index, kind, False)))
        index.unpersist()
        more += 1
    if more:
        rows = rows.groupBy("shard", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(x) for x in batch.column(3).to_pylist()]
            hit = np.array([_covered(x) for x in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    _text.ints(hit),
                    _text.ints(np.array([len(x) for x in lists], np.int64)),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
                    pa.array(hit > 0),
                    batch.column(4),
                    pa.array(lists, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "items"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("longest", "long").add("items", T.ArrayType(T.StringType()))
    return rows.select("doc_id", "n_words", "spans", "items", "longest").mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The verbatim matches that can't be lengthened: document, item, first word in either, and number of words."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = shards(docs, _store.place(docs.sparkSession, "suffix-arrays"), id_col, text_col, window)

    def matches(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, ids, shard in _read(batch):
                    doc, item, place, other, n = _matches(index.value, *shard.search(index.value))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(list(index.value.names[item]), pa.string()), _text.ints(place), _text.ints(other), _text.ints(n)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        return table.mapInArrow(run, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")

    # An item is in one part alone, so the parts' matches are the whole's.
    first, *rest = [matches(index) for index in prepare(benchmark, window=window, **options)]
    for more in rest:
        first = first.unionByName(more)
    return first


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The documents without any occurrence, with all their columns.

    A batch's shards are built and searched where the batch is, once for each part of the benchmark, so that whole rows
    pass through and none is shuffled.
    """

    def without(table: DataFrame, index) -> DataFrame:
        def clean(texts: pa.Array) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            for i, _, shard in _pieces(texts, window):
                keep[i + shard.search(index.value)[0]] = False
            return keep

        return _store.filtered(table, text_col, clean)

    for index in prepare(benchmark, window=window, **options):
        docs = without(docs, index)
    return docs
