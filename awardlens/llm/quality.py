"""Quality classifier: a weak-label model, then a hashed linear scorer.

LABELLERS vote on every document: 1 good, 0 none, -1 bad. Expectation-maximisation over the counts of the vote
patterns, at most 3**len(LABELLERS) rows gathered from all documents, estimates each labeller's chance of each vote
for good and bad documents, and the share of good ones. A document's posterior follows from its votes alone.

The posteriors of a bounded sample (``sample`` documents of ``sample_bytes`` bytes at most, about; those with the least hash of id and text) are the targets of a logistic
scorer over hashed terms: words, their shapes, and words that repeat the one before. It is trained on the driver
and scores every document; score and posterior are averaged in logits for the decision.

Defined results: a null or empty text has no words, which the labeller no_words calls bad; texts are read whole; an
empty table gives an empty table; if no document is voted on, every posterior is a half. Repeated rows get a row
each; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

BITS = 16
SAMPLE = 16_000
SAMPLE_BYTES = 1 << 27
_UPPER, _LETTER, _LINE, _COMMON = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LINE[:] = True
_LINE[0x0A] = False
_COMMON[:] = _LETTER
_COMMON[0x30:0x3A] = True
_COMMON[[*b" \n\t\r.,;:'\"()-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?:;\")"]] = True
#: A byte's kind in a word's shape.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:] = 0x39, 0x41, 0x61, 0x61


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def measures(b: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, for each document of a chunk."""
    docs = len(at) - 1
    size = np.diff(at)

    def per(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[at[1:]] - c[at[:-1]]

    s, e = _text.spans(b, at, _text.NOT_SPACE)
    doc = np.searchsorted(at, s, side="right") - 1
    n = np.bincount(doc, minlength=docs)
    h = _text.hashes(_text.LOWER[b], (s, e))[0]
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    run = np.diff(np.append(np.flatnonzero(first), len(h)))
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc[order][first], run)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    ls, le = _text.spans(b, at, _LINE)
    line_doc = np.searchsorted(at, ls, side="right") - 1
    lines = np.bincount(line_doc, minlength=docs)
    lh = _text.hashes(b, (ls, le))[0]
    _, one = np.unique(np.stack([line_doc.astype(np.uint64), lh]), axis=1, return_index=True) if len(lh) else (None, np.zeros(0, np.int64))
    return {
        "words": n,
        "distinct": _mean(np.bincount(doc[order][first], minlength=docs), n),
        "top": _mean(most, n),
        "again": _mean(np.bincount(doc[again], minlength=docs), n),
        "letters": _mean(np.bincount(doc, weights=e - s, minlength=docs), n),
        "odd": _mean(size - per(_COMMON[b]), size),
        "odd_words": _mean(np.bincount(doc, weights=~_COMMON[b[e - 1]] if len(e) else None, minlength=docs), n),
        "upper": _mean(per(_UPPER[b]), per(_LETTER[b])),
        "lines": lines,
        "line_again": 1 - np.where(lines > 0, _mean(np.bincount(line_doc[one], minlength=docs), lines), 1),
        "line_stop": _mean(np.bincount(line_doc, weights=_STOP[b[le - 1]] if len(le) else None, minlength=docs), lines),
    }


def _bad(fault: np.ndarray) -> np.ndarray:
    return np.where(fault, -1, 0)


#: Name and votes. Most look for one fault, and their ranges overlap; the last two look for prose.
LABELLERS = {
    "no_words": lambda m: _bad(m["words"] == 0),
    "symbols": lambda m: _bad(m["odd"] > 0.06),
    "odd_words": lambda m: _bad((m["words"] >= 10) & (m["odd_words"] > 0.2)),
    "capitals": lambda m: _bad((m["words"] >= 5) & (m["upper"] > 0.35)),
    "word_again": lambda m: _bad((m["words"] >= 10) & (m["again"] > 0.2)),
    "variety": lambda m: _bad((m["words"] >= 30) & (m["distinct"] < 0.25)),
    "top_word": lambda m: _bad((m["words"] >= 30) & (m["top"] > 0.18)),
    "word_length": lambda m: _bad((m["words"] >= 10) & ((m["letters"] < 2) | (m["letters"] > 16))),
    "lines_again": lambda m: _bad((m["lines"] >= 4) & (m["line_again"] > 0.3)),
    "sentences": lambda m: np.where((m["words"] >= 1) & (m["line_stop"] >= 0.6) & (m["upper"] < 0.15), 1, 0),
    "rich": lambda m: np.where((m["words"] >= 1) & (m["distinct"] >= 0.35) & (m["odd"] < 0.02), 1, 0),
}


def votes(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The votes of a chunk's documents as a number each: three to the power of the labeller, times vote + 1."""
    m = measures(b, at)
    return sum((f(m).astype(np.int64) + 1) * 3**k for k, f in enumerate(LABELLERS.values()))


@dataclass
class WeakModel:
    """The share of good documents and chance[label, labeller, vote + 1]."""

    good: float
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        digits = np.asarray(patterns, np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        log = np.log(np.array([1 - self.good, self.good]))[:, None] + np.log(self.chance)[:, np.arange(len(LABELLERS)), digits].sum(axis=2)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def fit_weak(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> WeakModel:
    """Expectation-maximisation; an abstention is a vote of its own. It starts where any vote for bad makes a document
    bad, as the labellers look at different faults."""
    k = len(LABELLERS)
    if not len(patterns):
        return WeakModel(0.5, np.full((2, k, 3), 1 / 3))
    digits = patterns[:, None] // 3 ** np.arange(k) % 3
    p = np.where((digits == 0).any(axis=1), 0.05, 0.98)
    for _ in range(rounds):
        both = np.stack([counts * (1 - p), counts * p])
        share = np.clip(both.sum(axis=1) / both.sum(), 1e-4, 1 - 1e-4)
        chance = np.stack([[np.bincount(digits[:, j], weights=w, minlength=3) for j in range(k)] for w in both]) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        model = WeakModel(float(share[1]), chance)
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def terms(b: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk: borders, buckets, and each term's share of its document's, square-rooted."""
    s, e = _text.spans(b, at, _text.NOT_SPACE)
    doc = np.searchsorted(at, s, side="right") - 1
    h = _text.hashes(_text.LOWER[b], (s, e))[0]
    # A shape keeps the first of each run of one kind: the other bytes hash as nothing.
    kind = _KIND[b]
    fresh = np.ones(len(b), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[s] = True
    places = np.cumsum(fresh) - 1
    short = kind[fresh]
    shape = _text.hashes(short, (places[s], places[e - 1] + 1))[0] ^ np.uint64(0x5851F42D4C957F2D) if len(s) else h
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    extra = np.full(int(again.sum()), 0x14057B7EF767814F, np.uint64)
    all_h, all_doc = np.concatenate([h, shape, extra]), np.concatenate([doc, doc, doc[again]])
    key, count = np.unique(all_doc * np.int64(1 << bits) + (all_h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    row = key >> bits
    n = np.bincount(doc, minlength=len(at) - 1)
    return np.searchsorted(row, np.arange(len(at))), key & ((1 << bits) - 1), np.sqrt(count / np.maximum(n[row], 1))


@dataclass
class Scorer:
    bias: float
    w: np.ndarray
    weak: WeakModel

    def logits(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        border, column, value = terms(b, at)
        c = np.concatenate([[0.0], np.cumsum(self.w[column] * value)])
        return self.bias + c[border[1:]] - c[border[:-1]]


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n: int, epochs: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on the logistic loss of soft targets; good and bad weigh alike."""
    rng = np.random.default_rng(seed)
    w, m1, m2, bias, b1, b2, step = np.zeros(n), np.zeros(n), np.zeros(n), 0.0, 0.0, 0.0, 0
    good = float(np.clip(target.mean(), 0.01, 0.99))
    weight = np.sqrt(target * 0.5 / good + (1 - target) * 0.5 / (1 - good))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            at = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            column = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in pick])
            c = np.concatenate([[0.0], np.cumsum(w[column] * value)])
            z = bias + c[at[1:]] - c[at[:-1]]
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[pick]) / len(pick)
            seen, inverse = np.unique(column, return_inverse=True)
            grad = np.bincount(inverse, weights=np.repeat(g, np.diff(at)) * value, minlength=len(seen)) + decay * w[seen]
            step += 1
            m1[seen] = 0.9 * m1[seen] + 0.1 * grad
            m2[seen] = 0.999 * m2[seen] + 0.001 * grad**2
            f1, f2 = 1 - 0.9**step, 1 - 0.999**step
            w[seen] -= rate * (m1[seen] / f1) / (np.sqrt(m2[seen] / f2) + 1e-8)
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
            bias -= rate * (b1 / f1) / (np.sqrt(b2 / f2) + 1e-8)
    return float(bias), w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Scorer:
    """The weak model of all documents and the scorer of a sample: about ``sample`` rows, and ``sample_bytes`` bytes of text, at most."""
    _store.bounded(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(3 ** len(LABELLERS), np.int64), np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, b, at in _text.chunks(batch.column(0)):
                pattern = votes(b, at)
                total += np.bincount(pattern, minlength=len(total))
                np.add.at(size, pattern, np.diff(at))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([_text.ints(seen), _text.ints(total[seen]), _text.ints(size[seen])], names=["pattern", "n", "size"])

    rows = own.select("_t").mapInArrow(count, "pattern long, n long, size long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).toPandas().sort_values("pattern")
    weak = fit_weak(rows["pattern"].to_numpy(), rows["n"].to_numpy())
    share = min(sample / max(1, int(rows["n"].sum())), sample_bytes / max(1, int(rows["size"].sum())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, at in _text.chunks(batch.column(0)):
                border, column, value = terms(b, at)
                cut = list(zip(border[:-1], border[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), _text.ints(votes(b, at)), pa.array([column[s:e].astype(np.uint16 if BITS <= 16 else np.uint32).tobytes() for s, e in cut], pa.binary()), pa.array([value[s:e].astype(np.float16).tobytes() for s, e in cut], pa.binary())],
                    names=["h", "pattern", "c", "v"],
                )

    part = F.pmod(F.xxhash64("_id", "_t", F.lit(3)), F.lit(1 << 30)) / (1 << 30)
    got = own.filter(part < share).select("_t", F.xxhash64("_id", "_t").alias("_h")).mapInArrow(encode, "h long, pattern long, c binary, v binary").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    if not got:
        return Scorer(0.0, np.zeros(1 << BITS), weak)
    target = weak.posterior(np.array([r[1] for r in got]))
    bags = [(np.frombuffer(r[2], np.uint16 if BITS <= 16 else np.uint32), np.frombuffer(r[3], np.float16).astype(np.float32)) for r in got]
    return Scorer(*fit_linear(bags, target, 1 << BITS), weak)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the weak labels' posterior, the scorer's score, and keep: whether their mean logit is at least 0."""
    shared = _store.bounded(docs.sparkSession).sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            for i, j, b, at in _text.chunks(batch.column(1)):
                p = model.weak.posterior(votes(b, at))
                z = np.clip(model.logits(b, at), -30, 30)
                keep = np.log(p / (1 - p)) + z >= 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array(1 / (1 + np.exp(-z))), pa.array(keep)], names=["doc_id", "posterior", "score", "keep"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("posterior", "double").add("score", "double").add("keep", "boolean")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
