"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a text (A-Z lower-cased, ``[0-9a-z]`` and all beyond ASCII) and their beginnings of
PREFIXES bytes, hashed to 2**bits buckets. Buckets are counted by label over all labelled rows, map-side into
dense vectors. All that SUPPORT labelled documents have enter the model, so a pair of terms that are neutral alone
can be learned. It is fitted in two steps: first on the terms whose log odds differ by more standard errors than the
largest of as many buckets without any difference would, sqrt(2 ln n), or that are among the LEAST_FEATURES best,
FEATURES at most; then, from there, on all terms together. The machine is

    score(x) = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),

so a pair of terms can weigh more than both together. x_i is log(1 + count) of the term, scaled by the log of the
text's length. It is fitted on a bounded sample of labelled rows (about ``sample`` rows and ``sample_bytes`` bytes of
text of either label at most, those with the least hash of id and text; rows alike in id, text and label train once),
with Adam, from a fixed seed.

Defined results: a null or empty text has no terms and gets the score of the bias; texts of any length are scored
whole; labels that are null, or of unknown documents, are left out, and if one document has several labels, each
counts; without labelled rows of both labels, in the table or in the sample, every score is the share of label 1 (0 without any). Repeated
documents get a row each, an empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

PREFIXES = (4, 5, 6)
BITS = 18
FEATURES = 8192
LEAST_FEATURES = 24
SUPPORT = 2
VISITS = 30_000
SAMPLE = 12_000
SAMPLE_BYTES = 128 << 20
FACTORS = 6
BROADCAST_ROWS = 2_000_000


def term_hashes(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all terms of a chunk with the document of each, and the number of words by document."""
    b = _text.LOWER[b]
    s, e = _text.spans(b, at, _text.ALNUM)
    doc = np.searchsorted(at, s, side="right") - 1
    longer = [np.flatnonzero(e - s > k) for k in PREFIXES]
    parts = _text.hashes(b, (s, e), *((s[x], s[x] + k) for x, k in zip(longer, PREFIXES, strict=True)))
    for k, h in zip(PREFIXES, parts[1:], strict=True):
        h ^= np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)  # a beginning is another term than the word alike
    return np.concatenate(parts), np.concatenate([doc, *(doc[x] for x in longer)]), np.bincount(doc, minlength=len(at) - 1)


def features(texts: pa.Array, column_of: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of sparse rows: first row, row after the last, row borders, columns and values."""
    for i, j, b, at in _text.chunks(texts):
        h, doc, n = term_hashes(b, at)
        column = column_of[h >> np.uint64(64 - bits)]
        inside = np.flatnonzero(column >= 0)
        key, count = np.unique(doc[inside] * np.int64(1 << 32) + column[inside], return_counts=True)
        row, column = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
        value = np.log1p(count) / np.sqrt(1 + np.log1p(n[row] / 64.0))
        yield i, j, np.searchsorted(row, np.arange(j - i + 1)), column, value


@dataclass
class Machine:
    bits: int
    column_of: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        def total(x: np.ndarray) -> np.ndarray:
            c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
            return c[at[1:]] - c[at[:-1]]

        vx = self.v[column] * value[:, None]
        return self.bias + total(self.w[column] * value) + 0.5 * (total(vx) ** 2 - total(vx**2)).sum(axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, at, column, value in features(texts, self.column_of, self.bits):
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.margin(at, column, value), -30, 30)))
        return out


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, factors: int = FACTORS, epochs: int = 25, batch: int = 128, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the logistic loss, either label with half of the weight."""
    rng = np.random.default_rng(seed)
    n_one = max(1, int(y.sum()))
    weight = np.where(y == 1, 0.5 * len(y) / n_one, 0.5 * len(y) / max(1, len(y) - n_one))
    weight = np.sqrt(weight)  # between the shares as they are and equal shares
    theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.02, (n, factors))], axis=1)
    m1, m2, bias, b1, b2, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            at = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            column = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), np.diff(at))
            own = theta[column]
            vx = own[:, 1:] * value[:, None]
            sums, squares, linear = np.zeros((len(pick), factors)), np.zeros(len(pick)), np.zeros(len(pick))
            np.add.at(sums, row, vx)
            np.add.at(squares, row, (vx**2).sum(axis=1))
            np.add.at(linear, row, own[:, 0] * value)
            z = bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            part = np.empty_like(own)
            part[:, 0] = g[row] * value
            part[:, 1:] = (g[row] * value)[:, None] * (sums[row] - vx)
            seen, inverse = np.unique(column, return_inverse=True)
            grad = np.zeros((len(seen), theta.shape[1]))
            np.add.at(grad, inverse, part)
            grad += decay * theta[seen]
            step += 1
            m1[seen] = 0.9 * m1[seen] + 0.1 * grad
            m2[seen] = 0.999 * m2[seen] + 0.001 * grad**2
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            theta[seen] -= rate * (m1[seen] / fix1) / (np.sqrt(m2[seen] / fix2) + 1e-8)
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
            bias -= rate * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8)
    return float(bias), theta[:, 0].copy(), theta[:, 1:].copy()


def refine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, start: tuple[float, np.ndarray, np.ndarray], epochs: int = 25, batch: int = 128, rate: float = 0.02, decay: float = 2e-4, seed: int = 11) -> tuple[float, np.ndarray, np.ndarray]:
    """The machine over n terms, from one over the first of them.

    The steps of all weights have one scale, and those of all factors: a term moves in proportion to its gradient,
    so rare ones, whose gradients are small, don't learn single documents by heart as each with a scale of its own would.
    Steps shrink with what the start leaves to explain, as a share of what the labels' shares alone leave.
    """
    rng = np.random.default_rng(seed)
    n_one = max(1, int(y.sum()))
    weight = np.sqrt(np.where(y == 1, 0.5 * len(y) / n_one, 0.5 * len(y) / max(1, len(y) - n_one)))
    bias, w, v = start
    factors = v.shape[1]
    theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.02, (n, factors))], axis=1)
    theta[: len(w), 0], theta[: len(w), 1:] = w, v
    m1, m2, b1, b2, step = np.zeros_like(theta), np.zeros(2), 0.0, 0.0, 0
    size = np.array([len(r[0]) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            at = np.concatenate([[0], np.cumsum(size[pick])])
            if not at[-1]:
                continue
            column = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick]).astype(float)
            row = np.repeat(np.arange(len(pick)), size[pick])
            vx = theta[column] * value[:, None]
            sums = np.concatenate([np.zeros((1, factors + 2)), np.cumsum(np.column_stack([vx, (vx[:, 1:] ** 2).sum(axis=1)]), axis=0)])
            sums = sums[at[1:]] - sums[at[:-1]]
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(axis=1) - sums[:, -1])
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            part = np.column_stack([np.ones(len(row)), sums[row, 1:-1] - vx[:, 1:]]) * (g[row] * value)[:, None]
            left = min(1.0, np.sqrt((g**2).sum() / ((weight[pick] * (y.mean() - y[pick]) / len(pick)) ** 2).sum()))
            by = np.argsort(column, kind="stable")
            seen, first = np.unique(column[by], return_index=True)
            grad = np.add.reduceat(part[by], first, axis=0) + decay * theta[seen]
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            m1[seen] = 0.9 * m1[seen] + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * np.array([(grad[:, 0] ** 2).max(), (grad[:, 1:] ** 2).max()])
            theta[seen] -= left * rate * (m1[seen] / fix1) / (np.sqrt(m2 / fix2) + 1e-8)[[0] + [1] * factors]
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
            bias -= left * rate * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8)
    return float(bias), theta[:, 0].copy(), theta[:, 1:].copy()


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = BITS, n_features: int = FEATURES, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """The machine for the labelled rows. usable: a condition on the id; sample, sample_bytes: rows of either label, and bytes of their texts, at most."""
    _store.bounded(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    if usable is not None:
        known = known.filter(usable)
    # Sixteen bytes a row: sent to every executor up to BROADCAST_ROWS rows, joined by a shuffle beyond.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 << bits, np.int64), 1: np.zeros(1 << bits, np.int64)}
        rows, size = np.zeros(2, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            rows += np.bincount(y, minlength=2)
            for i, j, b, at in _text.chunks(batch.column(0)):
                np.add.at(size, y[i:j], np.diff(at))
                h, doc, _ = term_hashes(b, at)
                once = np.unique(doc * np.int64(1 << bits) + (h >> np.uint64(64 - bits)).astype(np.int64))
                label = y[i:j][once >> bits]
                for k in (0, 1):
                    total[k] += np.bincount(once[label == k] & ((1 << bits) - 1), minlength=1 << bits)
        seen = np.flatnonzero(total[0] + total[1])
        yield pa.RecordBatch.from_arrays([_text.ints(np.append(seen, [-1, -2])), *(_text.ints(np.append(total[k][seen], [rows[k], size[k]])) for k in (0, 1))], names=["bucket", "n0", "n1"])

    # 2**bits + 2 rows at most come to the driver, to be ranked by smoothed log odds over their standard error.
    # Bucket -1 has the rows themselves, -2 the bytes of their texts: labels of unknown documents aren't among them, and repeated rows count as often as their terms do.
    seen = texts.select("_t", "_y").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("bucket").to_pandas()
    (n0, n1), sizes = ([int(seen.loc[seen["bucket"] == k, n].sum()) for n in ("n0", "n1")] for k in (-1, -2))
    column_of = np.full(1 << bits, -1, np.int64)
    toxic = min(max(n1 / max(n0 + n1, 1), 1e-9), 1 - 1e-9)
    untaught = Machine(bits, column_of.copy(), float(np.log(toxic / (1 - toxic))), np.zeros(1), np.zeros((1, FACTORS)))
    if not n1 or not n0:
        return untaught
    seen = seen[seen["bucket"] >= 0]
    a, b = seen["n0"].to_numpy() + 0.5, seen["n1"].to_numpy() + 0.5
    z = np.abs(np.log(b / (n1 + 1 - b)) - np.log(a / (n0 + 1 - a))) / np.sqrt(1 / a + 1 / b)
    order = np.argsort(-z, kind="stable")[:n_features]
    best = seen["bucket"].to_numpy()[order[(z[order] > np.sqrt(2 * np.log(max(len(z), 2)))) | (np.arange(len(order)) < LEAST_FEATURES)]]
    rest = np.setdiff1d(seen["bucket"].to_numpy()[(seen["n0"] + seen["n1"]).to_numpy() >= SUPPORT], best)
    column_of[best] = np.arange(len(best))
    column_of[rest] = len(best) + np.arange(len(rest))

    # The rows of either label whose hash is least: a threshold on the hash, no sort. The texts of one id have a hash each.
    part = F.pmod(F.xxhash64("_id", "_t", F.lit(9)), F.lit(1 << 30)) / (1 << 30)
    share = [min(sample / n, sample_bytes / max(1, size)) for n, size in zip((n0, n1), sizes, strict=True)]
    picked = texts.filter(F.when(F.col("_y") == 1, part < share[1]).otherwise(part < share[0]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, column, value in features(batch.column(0), column_of, bits):
                cells = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (column.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), batch.column(1).slice(i, j - i), *cells], names=["h", "y", "c", "v"])

    # Copies under one id, however many, come to the driver once. About 8 bytes a term of a row; Arrow's own buffers hold them
    # once, and rows are views of those.
    got = picked.select("_t", "_y", F.xxhash64("_id", "_t").alias("_h")).mapInArrow(encode, "h long, y int, c array<int>, v array<float>").dropDuplicates(["h", "y"]).toArrow()
    rows, key, y = [], got.column("h").to_numpy(), got.column("y").to_numpy().astype(float)
    for c, v in zip(got.column("c").chunks, got.column("v").chunks, strict=True):
        at = c.offsets.to_numpy()
        columns, values = c.values.to_numpy(), v.values.to_numpy()
        rows += [(columns[s:e], values[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
    del got
    order = np.lexsort((y, key))
    y, rows = y[order], [rows[k] for k in order]
    if len(set(y)) < 2:  # the only texts of a label are longer than the sample may be
        return untaught
    start = fit_machine([(c[c < len(best)], x[c < len(best)].astype(float)) for c, x in rows], y, max(1, len(best)))
    machine = Machine(bits, column_of, *refine(rows, y, max(1, len(best) + len(rest)), start, epochs=max(2, min(25, VISITS // max(1, len(rows))))))
    # The driver lives on: nothing of the sample stays in it.
    rows.clear()
    c = v = columns = values = None
    _text.release()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = _store.bounded(docs.sparkSession).sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("score", "double"))


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = _store.bounded(docs.sparkSession).sparkContext.broadcast(machine)
    return _store.filtered(docs, text_col, lambda texts: shared.value.score(texts) < threshold)
