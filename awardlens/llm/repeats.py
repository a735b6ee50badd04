"""Repeated passages, by prefix-free parsing: every byte that an earlier copy of LENGTH bytes covers.

A trigger is a gram of GRAM bytes whose rolling hash is 0 modulo MODULUS. A window of LENGTH bytes belongs to its leftmost
trigger; one without any, in a stretch that the modulus leaves uncut, to its gram of least hash. What a window belongs to
follows from its bytes alone, so equal windows belong to equal triggers at the same place. A trigger is widened to the
window's CORE bytes on the side where it has room: windows with one core are a class, which can be settled alone.

1. The parse: neighbouring windows with one core are a phrase. Each text gives its phrases' core hashes. A core that only
   one place has can't be in a repeated window; the rest, few in ordinary text, go back to their texts. A core that more
   than HOT texts have is split: windows by how many bytes they have before it, finely where few are left on either side,
   each part by the bytes that all its windows share.
2. The dictionary: the phrases with these cores are cut from the texts, each from its first window to the core's end, and
   with them what follows in the parse, as far as a window reaches. Those alike within a batch are sent once.
3. In each class, the suffix array of the dictionary's distinct phrases ranks where a window begins, the suffix array of
   the distinct continuations, with its common prefixes, ranks how it ends. Both ranks together are the window's place
   in the order of the corpus's suffixes cut to LENGTH bytes; equal ranks are equal bytes, and of these the least document
   and place stays.
4. The bytes of all others, as intervals sorted by document and joined as they stream by, go back to the documents.

Suffixes are compared by bytes; hashes only choose what is compared. Copies of whole texts are known by two 64-bit hashes
and parsed once. A class's task holds the class's distinct phrases; alike ones of other batches are told by the sort order.

Defined results: a null text is empty and has no window; the bytes of a null doc_id come before all others; equal
doc_ids count as one document, the lesser place first, and texts that share a window at the same place of one id keep
it; rows alike in id and text get one result each; texts are read whole, in pieces if need be; an empty table gives an
empty table. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

LENGTH, GRAM, MODULUS = 100, 24, 64
#: Bytes of listed cores, and of intervals, that are sent to every executor; beyond, the texts are shuffled.
BROADCAST_BYTES = 1 << 20
#: Texts with a core beyond which its windows are split.
HOT = 1000
#: Rows of classes settled together, and the parts that a core's or a whole text's rows are dealt to in joins.
ROWS, SALTS = 8192, 8
#: Windows compared at once, about; those with more and fewer bytes before their core are never alike.
WINDOWS = 1 << 21
_PIECE, _PLACE = 1 << 22, 24
_KEY = ["id", "k", "k2"]


def _sides(length: int, gram: int) -> tuple[int, int, int]:
    """Bytes that widen a trigger to a core, bytes of a window around its core, and the core's."""
    side = (length - gram) // 2
    return side, length - gram - side, gram + side


def _parts(around: int) -> list[tuple[int, int]]:
    """Ranges of the bytes before a core: 0, 1, 2 to 3, 4 to 7, ... and the same for the bytes after it."""
    out, low = [], 0
    while low <= around // 2:
        out.append((low, min(max(low, 2 * low - 1), around // 2)))
        low = out[-1][1] + 1
    for p, q in out[::-1]:
        out.append((max(around - q, around // 2 + 1), around - p))
    return [x for x in out if x[0] <= x[1]]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, count numbers long, one after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _runs(on: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values; a run also ends before a place that is new."""
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1] | new[1:]
    last[:-1] &= ~on[1:] | new[1:]
    return np.flatnonzero(first), np.flatnonzero(last)


def _triggers_of(piece: np.ndarray, at: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and trigger of each run of a piece's windows with one trigger."""
    n, rest = len(piece) - gram + 1, length - gram
    h = _text.hashes(piece, (np.arange(n), np.arange(n) + gram))[0]
    t = np.flatnonzero(h % np.uint64(MODULUS) == 0)
    doc = np.searchsorted(at, t, side="right") - 1
    lo = np.maximum(np.maximum(np.concatenate([[0], t[:-1] + 1])[: len(t)], t - rest), at[doc])
    hi = np.minimum(np.minimum(t, len(valid) - 1), at[np.minimum(doc + 1, len(at) - 1)] - length)
    own = lo <= hi
    t, lo, hi = t[own], lo[own], hi[own]
    cover = np.zeros(len(valid) + 1, np.int8)
    cover[lo] += 1
    np.subtract.at(cover, hi + 1, 1)
    free = valid & (np.cumsum(cover[:-1], dtype=np.int8) == 0)
    s, e = _runs(free, np.zeros(len(free), bool))
    if not len(s):
        return lo, hi, t
    count = e - s + 1
    at_gram = _ranges(s, count + rest)
    keys = (h[at_gram] >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at_gram.astype(np.uint64)
    begin = np.cumsum(count + rest) - count - rest
    least = (_least(keys, rest + 1)[_ranges(begin, count)] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    window = _ranges(s, count)
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)
    first, last = _runs(np.ones(len(window), bool), new)
    return np.concatenate([lo, window[first]]), np.concatenate([hi, window[last]]), np.concatenate([t, least[first]])


def parse(b: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a chunk's documents: document, first and last window, place of the core, and its hash."""
    side, around, core = _sides(length, gram)
    parts = [[np.zeros(0, np.int64)] * 4]
    inside = np.zeros(len(b) + 1, np.int32)
    long = np.diff(at) >= length
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    for k in range(0, max(0, len(b) - length + 1), _PIECE):
        piece = b[k : min(len(b), k + _PIECE + length - 1)]
        lo, hi, t = _triggers_of(piece, at - k, inside[k : k + len(piece) - length + 1], length, gram)
        # A window that begins near its trigger has its core to the right, the others to the left.
        near = hi >= t - around
        far = lo < t - around
        lo, hi, g, kind = (np.concatenate(x) for x in ((np.maximum(lo, t - around)[near], lo[far]), (hi[near], np.minimum(hi, t - around - 1)[far]), (t[near], t[far] - side), (np.zeros(near.sum(), np.uint64), np.ones(far.sum(), np.uint64))))
        h = _text.hashes(piece, (g, g + core))[0] ^ (kind * np.uint64(0x9E3779B97F4A7C15))
        parts.append([lo + k, hi + k, g + k, h.view(np.int64)])
    lo, hi, g, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(lo, kind="stable")
    lo, hi, g, h = lo[order], hi[order], g[order], h[order].astype(np.int64)
    return np.searchsorted(at, lo, side="right") - 1, lo, hi, g, h


def _lists(rows: int, doc: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _cores(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The cores of each text that its batch hasn't met before; those it has more than once again in ``twice``."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        for i, j, b, at in _text.chunks(batch.column(1)):
            fresh = np.zeros(j - i, bool)
            for d, key in enumerate(keys[i:j]):
                fresh[d] = key not in seen
                seen.add(key)
            doc, _, _, _, h = parse(b, at, length, gram)
            keep = fresh[doc]
            doc, h = doc[keep], h[keep]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i), _text.ints(np.diff(at)), _lists(j - i, doc[~same], h[~same]), _lists(j - i, doc[same], h[same])],
                names=[*_KEY, "n", "once", "twice"],
            )


def _joined(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents joined where they meet, in order of document and place."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    # Documents are moved apart by more than any text's length.
    top = np.maximum.accumulate(e + doc * (1 << 40)) - doc * (1 << 40) if len(e) else e
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > top[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], s[first], top[last]


def _phrases(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The listed phrases with what follows them: core's hash, its place (s), bytes before it (e), and the bytes.

    A phrase that the batch has alike earlier in the corpus is repeated whole; it gives an interval s..e without bytes.
    """
    names = ["h", *_KEY, "s", "e", "text"]
    _, around, core = _sides(length, gram)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, b, at in _text.chunks(batch.column(1)):
            doc, lo, hi, g, h = parse(b, at, length, gram)
            own = batch.column(4).slice(i, j - i)
            listed, border = own.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))])
            keep = np.zeros(len(h), bool)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            for d in range(j - i):
                if border[d] < border[d + 1]:
                    keep[cut[d] : cut[d + 1]] = np.isin(h[cut[d] : cut[d + 1]], listed[border[d] : border[d + 1]])
            doc, lo, hi, g, h = doc[keep], lo[keep], hi[keep], g[keep], h[keep]
            if not len(h):
                continue
            common = batch.column(5).slice(i, j - i).flatten().unique().to_numpy(zero_copy_only=False)
            hot = np.isin(h, common) if len(common) else np.zeros(len(h), bool)
            if hot.any():
                split = [[x[~hot] for x in (doc, lo, hi, g, h)]]
                for low, high in _parts(around):
                    some = hot & (g - hi <= high) & (g - lo >= low)
                    d, start, end, at_core, name = doc[some], np.maximum(lo[some], g[some] - high), np.minimum(hi[some], g[some] - low), g[some], h[some].view(np.uint64)
                    inner = _text.hashes(b, (at_core - low, at_core + core + around - high))[0]
                    split.append([d, start, end, at_core, _text.mix(_text.mix(name ^ inner) + np.uint64(low)).view(np.int64)])
                doc, lo, hi, g, h = (np.concatenate(x) for x in zip(*split, strict=True))
            size = hi + length - lo
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(b[_ranges(lo, size)])]).cast(pa.binary())
            code, place, before, mine = texts.dictionary_encode().indices.to_numpy(), g - at[doc], g - lo, ids[i:j][doc]
            order = np.lexsort((place, mine, before, code, h))
            new = np.ones(len(h), bool)
            for x in (h, code, before):
                new[1:] &= x[order][1:] == x[order][:-1]
            new[1:] = ~new[1:]
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            again = np.zeros(len(h), bool)
            again[order] = (mine[order] != mine[first]) | (place[order] != place[first])
            for some in (~again, None):
                if some is None:
                    d, s, e = _joined(doc[again], (lo - at[doc])[again], (hi + length - at[doc])[again])
                    row, head, tail = pa.array(d + i), pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.binary())
                else:
                    row, head, s, e, tail = pa.array(doc[some] + i), pa.array(h[some]), place[some], before[some], texts.filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([head, batch.column(0).take(row), batch.column(2).take(row), batch.column(3).take(row), _text.ints(s), _text.ints(e), tail], names=names)


def _words(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> list[np.ndarray]:
    """Strings of width bytes at most, filled up with zeros, as columns of 64-bit numbers with the strings' order."""
    wide = -(-width // 8) * 8
    if not len(flat):
        return [np.zeros(len(begin), np.uint64)] * (wide // 8)
    place = begin[:, None] + np.arange(wide)
    cells = np.where(np.arange(wide) < size[:, None], flat[np.minimum(place, len(flat) - 1)], 0).astype(np.uint8)
    return list(cells.view(">u8").astype(np.uint64).T)


def _order(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by the first column, then the next; and which, in that order, differ from the one before."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for x in columns:
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
    return order, new


def _ranked(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rank among the distinct ones, and a row of each rank."""
    order, new = _order(*columns)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def windows_again(core_hash: np.ndarray, ids: np.ndarray, place: np.ndarray, before: np.ndarray, texts: pa.Array, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of windows that an earlier row has. Rows are sorted by class, id and place."""
    _, around, core = _sides(length, gram)
    flat, at = _text.raw(texts)
    after = np.diff(at) - before - core  # bytes that follow the core
    # Classes, by the core's bytes.
    group, _ = _ranked(core_hash, *_words(flat, at[:-1] + before, np.full(len(ids), core), core))
    # The dictionary's distinct phrases, and the distinct continuations in the order of their suffix array, whose
    # neighbours' common prefixes tell which are alike up to a length.
    phrase, one = _ranked(group, before, *_words(flat, at[:-1], before, around))
    cells = _words(flat, at[:-1] + before + core, after, around)
    follow, some = _ranked(*cells, after)
    bytes_ = np.stack([x[some] for x in cells], axis=1).astype(">u8").view(np.uint8)[:, :around]
    common = np.zeros(len(some), np.int64)
    if len(some) > 1:
        differ = np.concatenate([bytes_[1:] != bytes_[:-1], np.ones((len(some) - 1, 1), bool)], axis=1).argmax(axis=1)
        common[1:] = np.minimum(differ, np.minimum(after[some][1:], after[some][:-1]))
    need = length - core - after  # the bytes before the core that the last window has
    slices = max(1, int((before - need + 1).sum()) // WINDOWS)
    parts = []
    for sizes in np.array_split(np.arange(around + 1), min(slices, around + 1)):
        # The suffix array of the phrases before their cores, whose bytes are the class's: suffixes of these sizes.
        least, most = np.full(len(one), sizes[0]), np.minimum(before[one], sizes[-1])
        count = np.maximum(most - least + 1, 0)
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(one)), count)
        size = _ranges(least, count)
        suffix, _ = _ranked(group[one][owner], *_words(flat, (at[:-1] + before)[one][owner] - size, size, around), size)
        alike = np.cumsum(common[None, :] < (around - sizes)[:, None], axis=1, dtype=np.int32)
        # Windows, by start: the bytes before the core fall from all that the phrase has to what the last window needs.
        high = np.minimum(before, sizes[-1])
        n = np.maximum(high - np.maximum(need, sizes[0]) + 1, 0)
        row = np.repeat(np.arange(len(ids)), n)
        a = high[row] - _ranges(np.zeros(len(ids), np.int64), n)
        key = (suffix[begin[phrase[row]] + a - sizes[0]] << 32) | alike[a - sizes[0], follow[row]]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        earliest = row[first][which]
        again = (ids[row] != ids[earliest]) | (place[row] != place[earliest])
        new = np.zeros(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        s, e = _runs(again, new)
        parts.append((row[s], place[row[s]] - a[s], place[row[e]] - a[e] + length))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _settle(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Intervals of the repeated windows. Rows come by class, bytes before the core, bytes, and in corpus order."""
    held: list[pa.RecordBatch] = []
    count = 0

    def spans(rows: pa.Table, ends: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """The intervals of whole classes and of phrases alike, and the rows of the last class if it may go on."""
        rows = rows.combine_chunks()
        h, ids, place, before = (rows.column(k).to_numpy() for k in (0, 1, 4, 5))
        texts = rows.column(6).chunk(0)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (before[1:] == before[:-1]) & pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        whole = (ids != ids[head]) | (place != place[head])
        last = len(h) if ends else int(np.searchsorted(h, h[-1]))
        left = np.flatnonzero(~whole)
        own, rest = left[left < last], left[left >= last]
        own = own[np.lexsort((place[own], ids[own], h[own]))]
        done = np.flatnonzero(whole)
        r, s, e = done, (place - before)[done], (place - before + np.diff(_text.raw(texts)[1]))[done]
        if len(own):
            r2, s2, e2 = windows_again(h[own], ids[own], place[own], before[own], texts.take(pa.array(own)), length, gram)
            r, s, e = np.concatenate([r, own[r2]]), np.concatenate([s, s2]), np.concatenate([e, e2])
        key = [rows.column(k).to_numpy() for k in (1, 2, 3)]
        doc, one = _ranked(*(x[r] for x in key))
        doc, s, e = _joined(doc, s, e)
        return pa.RecordBatch.from_arrays([*(pa.array(x[r][one][doc]) for x in key), _text.ints(s), _text.ints(e)], names=[*_KEY, "s", "e"]), rows.take(pa.array(rest))

    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= ROWS:
            out, rest = spans(pa.Table.from_batches(held), False)
            yield out
            held, count = rest.to_batches(), 0
    if held:
        yield spans(pa.Table.from_batches(held), True)[0]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's intervals, joined where they meet, as s, e, s, e, ... Rows come by document and place."""
    key, runs = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([runs], pa.list_(pa.int64()))], names=[*_KEY, "spans"])

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(3)]
        doc = np.zeros(len(batch), np.int64)
        doc[1:] = np.cumsum(np.any([x[1:] != x[:-1] for x in columns], axis=0))
        own, s, e = _joined(doc, batch.column(3).to_numpy(), batch.column(4).to_numpy())
        cut = np.searchsorted(own, np.arange(doc[-1] + 2 if len(doc) else 1))
        first = np.searchsorted(doc, np.arange(len(cut) - 1))
        lists, keys = [], []
        for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            now = tuple(int(c[first[k]]) for c in columns)
            flat = np.stack([s[x:y], e[x:y]], axis=1).ravel().tolist()
            if now == key:
                if flat[0] <= runs[-1]:
                    # The batch before ended within this document; rows are sorted by start.
                    while flat and flat[0] <= runs[-1]:
                        runs[-1] = max(runs[-1], flat[1])
                        flat = flat[2:]
                runs += flat
            else:
                if key is not None:
                    lists.append(runs)
                    keys.append(key)
                key, runs = now, flat
        if lists:
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in keys], pa.int64()) for k in range(3)), pa.array(lists, pa.list_(pa.int64()))], names=[*_KEY, "spans"])
    if key is not None:
        yield row()


def _spans(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The documents as _id, _t, _k, _k2, and the intervals of those that lose bytes."""
    _store.bounded(docs.sparkSession)

    scratch = _store.Scratch("repeats")
    kept = scratch.kept
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"), text.alias("_t"), F.xxhash64(text).alias("_k"), F.xxhash64(F.lit(7), text).alias("_k2"))
    key = T.StructType().add("id", "long").add("k", "long").add("k2", "long")
    many = T.ArrayType(T.LongType())
    parsed = kept("parse", own.mapInArrow(lambda x: _cores(x, length, gram), T.StructType([*key.fields]).add("n", "long").add("once", many).add("twice", many)))

    # A core is listed if two texts have it, or one twice. In the join a common one's rows are dealt by their text.
    def salt(col: str) -> F.Column:
        return F.pmod(F.col(col), F.lit(SALTS)).cast("int")

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = parsed.select("k", F.explode("once").alias("h"))
    both = rows.unionByName(parsed.select(F.bitwise_not("k").alias("k"), F.explode("twice").alias("h")))
    shared = both.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), (F.count("*") > HOT).alias("hot")).filter("lo != hi").select("h", "hot", salts)
    listed = rows.withColumn("salt", salt("k")).join(shared, ["h", "salt"]).groupBy("k").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    firsts = parsed.filter(F.col("n") >= length).groupBy("k", "k2", "id").agg(F.count("*").alias("rows")).groupBy("k", "k2").agg(F.min(F.struct("id", "rows")).alias("least"), F.count("*").alias("ids"))
    names = kept("texts", firsts.select("k", "k2", "least.*", "ids"))
    listed = kept("listed", names.join(listed, "k").select(F.col("id").alias("_lid"), F.col("k").alias("_lk"), F.col("k2").alias("_lk2"), "rows", "hs", "hot"))
    size, most = listed.agg(F.sum(F.size("hs") * 8 + 64), F.max("rows")).first()
    if (size or 0) <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    found = own.join(listed, (F.col("_id") == F.col("_lid")) & (F.col("_k") == F.col("_lk")) & (F.col("_k2") == F.col("_lk2"))).select("_id", "_t", "_k", "_k2", "rows", "hs", "hot")
    # Rows alike in id and text are one document: parsed once, or each would repeat the other. Only their texts are shuffled.
    if (most or 0) > 1:
        found = found.filter("rows = 1").unionByName(found.filter("rows > 1").dropDuplicates(["_id", "_k", "_k2"]))
    found = found.drop("rows")
    schema = T.StructType([T.StructField("h", T.LongType()), *key.fields]).add("s", "long").add("e", "long").add("text", "binary")
    phrases = kept("phrases", found.mapInArrow(lambda x: _phrases(x, length, gram), schema))

    spans = T.StructType([*key.fields]).add("s", "long").add("e", "long")
    classes = phrases.filter("text is not null").repartition("h").sortWithinPartitions("h", "e", "text", "id", "s")
    again = classes.mapInArrow(lambda x: _settle(x, length, gram), spans)
    known = phrases.filter("text is null").select(*_KEY, "s", "e")
    merged = again.unionByName(known).repartition(*_KEY).sortWithinPartitions(*_KEY, "s").mapInArrow(_merge, T.StructType([*key.fields]).add("spans", many))
    # Every later copy of a whole text goes. Few texts have copies; the rows of one are dealt by their id.
    copied = names.filter("ids > 1").select("k", "k2", F.col("id").alias("first"), salts)
    copies = parsed.filter(F.col("n") >= length).select(*_KEY, "n", salt("id").alias("salt")).join(copied, ["k", "k2", "salt"]).filter("id > first")
    copies = copies.groupBy(*_KEY).agg(F.first("n").alias("n")).select(*_KEY, F.array(F.lit(0).cast("long"), F.col("n")).alias("spans"))
    spans = kept("spans", merged.unionByName(copies).select(F.col("id").alias("_sid"), F.col("k").alias("_sk"), F.col("k2").alias("_sk2"), "spans"))
    scratch.drop("parse", "texts", "listed", "phrases")
    size = spans.agg(F.sum(F.size("spans") * 8 + 64)).first()[0]
    return own, F.broadcast(spans) if (size or 0) <= BROADCAST_BYTES else spans


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each document its bytes, the removed ones, the runs of these, and the sha256 of what is left."""
    return remove(docs, id_col, text_col, length, gram).drop("kept")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes that are left."""
    own, spans = _spans(docs, id_col, text_col, length, gram)
    rows = own.join(spans, (F.col("_id") == F.col("_sid")) & (F.col("_k") == F.col("_sk")) & (F.col("_k2") == F.col("_sk2")), "left").select("_id", "_t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, at in _text.chunks(batch.column(1)):
                left, removed, runs = [], [], []
                for d, cells in enumerate(batch.column(2).slice(i, j - i).to_pylist()):
                    data = b[at[d] : at[d + 1]].tobytes()
                    cells = cells or []
                    edges = [0, *cells, len(data)]
                    left.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append(len(data) - len(left[-1]))
                    runs.append(len(cells) // 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), _text.ints(np.diff(at)), _text.ints(removed), _text.ints(runs), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array(left, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    schema = T.StructType().add("id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    return rows.mapInArrow(run, schema).select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
