"""Token-ID output: documents as one stream of ids, in patched frame-of-reference blocks.

Documents are dealt by range of doc_id, or of another order given, and sorted within a range. Each task encodes its documents and writes
segments of at least SEGMENT ids: the documents' ids and lengths, and an image of blocks (see pfor). A segment says
how many ids of its part come before it, so a document's start in the whole stream needs a sum over parts alone.

Texts are encoded by the given tokenizers file. Its splitting pattern is applied to the bytes first, and the library
encodes each distinct piece once; a text with other characters than ASCII and Latin letters up to U+024F goes to the
library as it is.

Defined results: null and empty texts are the end id alone; documents with one doc_id come in the order of a hash of
their texts; a null doc_id comes first; an empty table gives an empty stream. Only the id, an integer, and the text
are read. A text that holds an added token's string, such as a special one's, goes to the library as it is, which
makes the token's id of it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store, _text, pfor

END = 2
SEGMENT = 1 << 20
_PART = 1 << 19
#: Pieces a worker remembers; beyond, it keeps those that came again. Longer ones than LONGEST aren't kept.
PIECES, LONGEST = 500_000, 64
_SLOTS = 21
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
#: The kind of a byte. Beyond ASCII only U+00C0 to U+024F is split here, all letters but for two signs.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _LETTER
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_UNSURE = np.zeros(256, bool)
_UNSURE[0x1C:0x20] = _UNSURE[0xC0:0xC3] = _UNSURE[0xCA:] = True


def sure(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents of a chunk have no characters but those that split knows."""
    bad = _UNSURE[b]
    lead = np.flatnonzero(b[:-1] == 0xC3)
    sign = lead[(b[lead + 1] == 0x97) | (b[lead + 1] == 0xB7)]
    bad[sign] = True
    c = np.concatenate([[0], np.cumsum(bad)])
    return c[at[1:]] == c[at[:-1]]


def split(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of a chunk's documents begin; a piece ends where the next begins.

    That is the pattern of byte-level vocabularies: an English ending after an apostrophe; letters, digits or other
    signs with a space before; white space, whose last character is left to what follows, if it is a space, or is a
    piece of its own.
    """
    if not len(b):
        return np.zeros(0, np.int64)
    kind = _KIND[b]
    begins = np.ones(len(b), bool)
    begins[1:] = kind[1:] != kind[:-1]
    border = np.zeros(len(b) + 1, bool)
    border[at] = True
    begins |= border[:-1]
    run = np.flatnonzero(begins)
    # Runs that follow white space in their document.
    after = run[1:][(kind[run[1:] - 1] == _SPACE) & ~border[run[1:]]]
    spaced = after[b[after - 1] == 0x20]
    # A lone apostrophe that no space belongs to, before letters.
    mark = run[b[run] == 0x27]
    mark = mark[mark + 1 < len(b)]
    mark = mark[(kind[mark + 1] == _LETTER) & ~border[mark + 1]]
    mark = mark[(mark == 0) | border[mark] | (b[np.maximum(mark - 1, 0)] != 0x20)]
    if len(mark):
        one = b[mark + 1]
        two = np.where((mark + 2 < len(b)) & ~border[np.minimum(mark + 2, len(b))], b[np.minimum(mark + 2, len(b) - 1)], 0)
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        size = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, np.where(long, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        begins[mark + 1] = False
        end = mark + 1 + size
        begins[end[end < len(b)]] = True
    begins[after - 1] = True
    begins[spaced] = False
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts by a tokenizers file's content."""

    def __init__(self, content: str):
        # A worker is one of several processes on its machine.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        added = sorted({x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        # Only a byte-level model that splits by its usual pattern, without a normalizer, is taken apart.
        self.apart = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in str(self.tokenizer.pre_tokenizer) and "use_regex=True" in str(self.tokenizer.pre_tokenizer)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for name, k in self.tokenizer.get_vocab().items():
            self.opens[k] = name.startswith("\u0120")
        # Of each piece its hash, where its ids are and how many, how often it came, and whether it may be kept.
        self.n, self.used, self.ids = 0, 0, np.zeros(1 << 16, np.uint32)
        self.key, self.start, self.size, self.hits, self.short = (np.zeros(1 << 12, kind) for kind in (np.uint64, np.int64, np.int32, np.int32, bool))
        self._keep(np.zeros(0, np.int64))

    # Pieces are known by a 64-bit hash, each with a number. Its number is in the first table at the slot of its hash's
    # upper bits, or, if that was taken, in the second at the slot of its lower bits; one that is pushed out is new again.

    def _enter(self, first: int) -> None:
        number, own = np.arange(first, self.n, dtype=np.int32), self.key[first : self.n]
        upper, lower = own >> np.uint64(64 - _SLOTS), own & np.uint64((1 << _SLOTS) - 1)
        free = self.one[upper] < 0
        self.one[upper[free]] = number[free]
        self.two[lower[~free]] = number[~free]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for one that isn't known."""
        number = self.one[h >> np.uint64(64 - _SLOTS)]
        other = np.flatnonzero((number < 0) | (self.key[number] != h))
        second = self.two[h[other] & np.uint64((1 << _SLOTS) - 1)]
        number[other] = np.where((second >= 0) & (self.key[second] == h[other]), second, -1)
        return number

    def _keep(self, which: np.ndarray) -> None:
        """Remember the pieces with these numbers alone."""
        size = self.size[which]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.start[which] - ends + size, size) + np.arange(size.sum())]
        self.n, self.used = len(which), len(ids)
        for x, own in ((self.key, self.key[which]), (self.short, self.short[which]), (self.size, size), (self.start, ends - size), (self.hits, 0)):
            x[: self.n] = own
        self.ids[: self.used] = ids
        self.one, self.two = np.full(1 << _SLOTS, -1, np.int32), np.full(1 << _SLOTS, -1, np.int32)
        self._enter(0)

    def _forget(self) -> None:
        """Keep the pieces that came more than once since the last time, half of the room at most."""
        best = np.argsort(-self.hits[: self.n], kind="stable")[: PIECES // 2]
        self._keep(np.sort(best[(self.hits[best] > 1) & self.short[best]]))

    def _add(self, which: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """The ids, one after the other, of the pieces with these numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[which] = self.used + np.cumsum(size) - size
        self.size[which] = size
        self.used += len(ids)

    def _learn(self, new: list[str], h: np.ndarray) -> None:
        """Encode new pieces; runs of a space and letters are joined, as the pattern parts them again."""
        base, self.n = self.n, self.n + len(new)
        if self.n > len(self.key):
            self.key, self.start, self.size, self.hits, self.short = (np.concatenate([x, np.zeros(max(len(x), len(new)), x.dtype)]) for x in (self.key, self.start, self.size, self.hits, self.short))
        self.key[base : self.n], self.hits[base : self.n] = h, 0
        self.short[base : self.n] = [len(x) <= LONGEST for x in new]
        rest, plain = [], []
        for k, x in enumerate(new):
            (plain if x[0] == " " and x[1:].isalpha() else rest).append(k)
        for i in range(0, len(plain), 1024):
            own = plain[i : i + 1024]
            (got,) = self.tokenizer.encode_batch_fast(["".join([new[k] for k in own])], add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            # Such a piece's first id has the space in it and its others haven't.
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(own) and at[0] == 0:
                self._add(base + np.array(own), ids, np.diff(np.append(at, len(ids))))
            else:
                rest += own
        for i in range(0, len(rest), 4096):
            own = rest[i : i + 4096]
            lists = [x.ids for x in self.tokenizer.encode_batch([new[k] for k in own], add_special_tokens=False)]
            self._add(base + np.array(own), np.array([y for x in lists for y in x], np.uint32), np.array([len(x) for x in lists], np.int64))
        self._enter(base)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def encode(self, b: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The ids of each document of a chunk."""
        if not self.apart:
            return [self._whole(b[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
        if self.n > PIECES:
            self._forget()
        able = sure(b, at)
        if self.added is not None:
            # A match over a border sends both documents to the library, which does no harm.
            for m in self.added.finditer(b):
                able[np.searchsorted(at, m.start(), side="right") - 1 : np.searchsorted(at, m.end(), side="left")] = False
        begins = split(b, at)
        ends = np.append(begins[1:], len(b))
        own = np.searchsorted(begins, at)
        if not able.all():
            keep = np.repeat(able, np.diff(own))
            begins, ends = begins[keep], ends[keep]
            own = np.concatenate([[0], np.cumsum(np.where(able, np.diff(own), 0))])
        h = _text.hashes(b, (begins, ends))[0]
        number = self._find(h)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            fresh, first, again = np.unique(h[lost], return_index=True, return_inverse=True)
            base = self.n
            data = b.tobytes()
            self._learn([data[s:e].decode() for s, e in zip(begins[lost[first]].tolist(), ends[lost[first]].tolist(), strict=True)], fresh)
            number[lost] = base + again
        self.hits += np.bincount(number, minlength=len(self.hits)).astype(np.int32)
        size = self.size[number]
        last = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.start[number] - last + size, size) + np.arange(size.sum())]
        cut = np.concatenate([[0], last])[own]
        return [ids[cut[k] : cut[k + 1]] if able[k] else self._whole(b[at[k] : at[k + 1]].tobytes()) for k in range(len(able))]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(content: str) -> Encoder:
    """The process's encoder for a tokenizers file's content; the next task finds the pieces that it knows."""
    if content not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content] = Encoder(content)
    return _ENCODERS[content]


def _segments(batches: Iterator[pa.RecordBatch], content: str, end: int) -> Iterator[pa.RecordBatch]:
    part, seq, before, encoder = TaskContext.get().partitionId(), 0, 0, encoder_of(content)
    names: list = []
    sizes: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        values = np.concatenate(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), _text.ints([before]), _text.ints([len(values)]), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pfor.encode(values)], pa.binary())],
            names=["part", "seq", "before", "n_ids", "doc_ids", "sizes", "image"],
        )

    for batch in batches:
        for i, j, b, at in _text.chunks(batch.column(1), _PART):
            names += batch.column(0).slice(i, j - i).to_pylist()
            for ids in encoder.encode(b, at):
                parts.append(np.append(ids, np.uint32(end)))
                sizes.append(len(ids) + 1)
                held += len(ids) + 1
            if held >= SEGMENT:
                yield flush()
                seq, before, held = seq + 1, before + held, 0
                names, sizes, parts = [], [], []
    if held:
        yield flush()


_SCHEMA = "part int, seq int, before long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, image binary"


def written_order(docs: DataFrame) -> list[Column]:
    """The order of the rows of a table read from Spark's Parquet files: number and name of the file, and row in it.

    A frame that isn't read from files has no such order, and gets none.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return []
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), name, F.col("_metadata.row_index")]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, order: list[Column] | None = None) -> None:
    """Write the documents' ids as segments in a Parquet table at path, which all executors can reach.

    tokenizer: the path of a tokenizers file; the driver reads it. order: columns to sort the stream by, before doc_id.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = _store.bounded(docs.sparkSession).sparkContext.broadcast(f.read())
    first = order or []
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), *(x.alias(f"_o{k}") for k, x in enumerate(first)))
    by = [*(f"_o{k}" for k in range(len(first))), "_id", F.xxhash64("_t")]
    _store.write(own.repartitionByRange(*by).sortWithinPartitions(*by).select("_id", "_t").mapInArrow(lambda b: _segments(b, content.value, end), _SCHEMA), path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a written stream: doc_id, start, n_tokens, ids_crc32, and their ids on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                image = pfor.Image(batch.column(4)[k].as_py())
                ids, sizes = image.values(), np.array(batch.column(3)[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                each = np.split(ids, ends[:-1])
                columns = [
                    pa.array([batch.column(0)[k].as_py()] * len(sizes), pa.int32()),
                    pa.array(batch.column(2)[k].as_py(), pa.int64()),
                    _text.ints(batch.column(1)[k].as_py() + ends - sizes),
                    _text.ints(sizes),
                    pa.array([zlib.crc32(x.astype("<u4")) for x in each], pa.int64()),
                ]
                names = ["part", "doc_id", "own_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    table = spark.read.schema(_SCHEMA).parquet(path)
    rows = table.select("part", "before", "doc_ids", "sizes", "image").mapInArrow(run, "part int, doc_id long, own_start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)
    # A row for each part; their running sum is one small task.
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    totals = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    return rows.join(totals, "part").select("doc_id", (F.col("_base") + F.col("own_start")).alias("start"), *rows.columns[3:])
