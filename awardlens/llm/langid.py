"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams are taken of the lower-cased text with every run of other characters than letters made one space, for each
n in ORDERS, and hashed to 2**bits buckets. Counts by language come from a bounded sample of the labelled rows
(``sample`` of each language, those with the least hash), summed map-side. The matrix of log
probabilities, 2**bits floats a language, is broadcast (``max_languages`` bounds it); documents are scored in
batches in numpy as a sparse product: the n-grams of all documents of a chunk pick their entries, which are
summed by document.

Defined results: a null text or one without a letter is ``und`` with score 0; without training rows everything is
``und``. The score is the posterior of the best language, tempered by the square root of the number of n-grams,
as neighbouring n-grams aren't independent. Of equal languages the first by name wins. Texts are read whole.
Repeated documents get a row each; only the named columns are read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

ORDERS = (1, 2, 3)
BITS = 16
SAMPLE = 4000
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Runs of other characters than letters (category L). \w also has numbers that aren't digits, such as fractions. Texts
#: are cleaned by the table below, which tells the same and is some sixty times as fast.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_OTHER = re.compile(rf"[\W\d_{_NUMBERS}]+")
#: Whether a code point is a letter (category L).
_LETTER = np.array([chr(k).isalpha() for k in range(sys.maxunicode + 1)])
_PART = 1 << 19
#: Counts that a task holds before it adds up those of one n-gram and language.
_HELD = 1 << 20


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the cleaned texts, each with a space before and behind, and where each text begins."""
    framed = [f" {x.lower()} " for x in texts]
    at = np.cumsum([0, *map(len, framed)])
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[points]
    # Of a run of others the first one stays; before the first letter, and if there is none, that is the space in front.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = np.add.reduceat(letter, at[:-1], dtype=np.int64) > 0 if texts else False
    return np.where(letter, points, np.uint32(32))[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def grams(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of all n-grams, and where each text's begin."""
    points, at = _points(texts)
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] if len(points) >= n else h[:0]
        if n in ORDERS:
            bucket = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            bucket ^= bucket >> np.uint32(15)
            bucket *= np.uint32(0x2C1B3C6D)
            own = np.maximum(np.diff(at) - n + 1, 0)
            if n == 1:
                yield bucket >> np.uint32(32 - bits), at
            else:  # n-grams over the border of two texts are left out
                keep = np.ones(len(bucket), bool)
                for k in range(1, n):
                    edge = at[1:] - k
                    keep[edge[(edge >= 0) & (edge < len(bucket))]] = False
                yield bucket[keep] >> np.uint32(32 - bits), np.concatenate([[0], np.cumsum(own)])


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _PART characters; a longer one alone."""
    i, size = 0, 0
    for j, x in enumerate(texts):
        if j > i and size + len(x) > _PART:
            yield i, j
            i, size = j, 0
        size += len(x)
    if i < len(texts):
        yield i, len(texts)


@dataclass
class Model:
    names: list[str]
    bits: int
    prior: np.ndarray
    log_p: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, scores
        plain = [x or "" for x in texts]
        for i, j in _groups(plain):
            total, n = np.zeros((len(self.names), j - i)), np.zeros(j - i, np.int64)
            for bucket, at in grams(plain[i:j], self.bits):
                n += np.diff(at)
                for k, row in enumerate(self.log_p):
                    c = np.concatenate([[0.0], np.cumsum(row[bucket], dtype=np.float64)])
                    total[k] += c[at[1:]] - c[at[:-1]]
            best = (total + self.prior[:, None]).argmax(axis=0)
            z = (total / np.sqrt(np.maximum(n, 1)) + self.prior[:, None])
            z = np.exp(z - z.max(axis=0))
            share = z / z.sum(axis=0)
            for d in np.flatnonzero(n):
                names[i + d], scores[i + d] = self.names[best[d]], share[best[d], d]
        return names, scores


def fit(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", bits: int = BITS, sample: int = SAMPLE, max_languages: int = MAX_LANGUAGES) -> Model:
    """The model of the labelled rows. usable: a condition on docs; sample: rows of a language at most, about."""
    _store.bounded(docs.sparkSession)
    known = docs if usable is None else docs.filter(usable)
    known = known.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("l")).count().orderBy("l").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Model([], bits, np.zeros(0), np.zeros((0, 1 << bits)))
    names = [r[0] for r in sizes]
    number = {x: k for k, x in enumerate(names)}
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col) == r[0], min(1.0, sample / r[1])).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(place, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)

        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()])
            texts = batch.column(0).to_pylist()
            for i, j in _groups(texts):
                for bucket, at in grams(texts[i:j], bits):
                    own = np.repeat(lang[i:j], np.diff(at)) if j > i else lang[:0]
                    key, n = np.unique(own * (1 << bits) + bucket, return_counts=True)
                    keys.append(key)
                    sums.append(n)
                    held += len(key)
                if held > _HELD:
                    key, n = total()
                    keys, sums, held = [key], [n], 0
        key, n = total()
        yield pa.RecordBatch.from_arrays([_text.ints(key >> bits), _text.ints(key & ((1 << bits) - 1)), _text.ints(n)], names=["l", "b", "n"])

    rows = known.filter(part < share).select(text_col, lang_col).mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(names), 1 << bits), 0.5)
    counts[rows["l"], rows["b"]] += rows["n"]
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    prior = np.log(np.array([r[1] for r in sizes]) / sum(r[1] for r in sizes))
    return Model(names, bits, prior, log_p)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = _store.bounded(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("lang_pred", "string").add("score", "double"))
