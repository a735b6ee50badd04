"""Trained models: held-out accuracy on the tables, and defined results on odd rows."""

from __future__ import annotations

import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from awardlens.llm import langid, queries, quality, toxicity

from .conftest import sentence

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@tables
def test_language_held_out(spark):
    got = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_odd_rows(spark, docs, rows, none):
    model = langid.fit(docs.fillna("de", ["lang"]))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] != 21:
            letter = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] in ("de", "en")) == letter and (r["score"] > 0) == letter
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_language_is_naive_bayes(spark):
    """Counts and posteriors by plain loops over the hashed n-grams."""
    texts = {"de": ["der hund und", "die katze", "und das haus 12"], "en": ["the dog and", "a cat here"]}
    made = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    model = langid.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"), bits=10)

    def bag(text):
        return [int(b) for bucket, _ in langid.grams([text], 10) for b in bucket]

    counts = {lang: np.full(1 << 10, 0.5) for lang in texts}
    for _, t, lang in made:
        for b in bag(t):
            counts[lang][b] += 1
    asked = ["und die", "the house", "der the", "x"]
    names, scores = model.predict(asked)
    for t, name, score in zip(asked, names, scores, strict=True):
        own = bag(t)
        prior = {lang: np.log(len(x) / len(made)) for lang, x in texts.items()}
        total = {lang: sum(np.log(c[b] / c.sum()) for b in own) for lang, c in counts.items()}
        assert name == max(sorted(total), key=lambda x: total[x] + prior[x])
        z = {lang: np.exp(x / np.sqrt(len(own)) + prior[lang]) for lang, x in total.items()}
        assert score == pytest.approx(z[name] / sum(z.values()), abs=1e-4)


def test_language_letters_are_category_l():
    import unicodedata

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in every:
        assert (langid._OTHER.fullmatch(c) is None) == (unicodedata.category(c)[0] == "L")
    model = langid.Model(["a"], 8, np.zeros(1), np.zeros((1, 256)))
    assert model.predict(["½ ² ③", "Ⅷ", "_ 9 !", "ª"])[0] == ["und", "und", "und", "a"]


def test_language_batches_alike():
    texts = ["der Hund und die Katze", None, "the dog and the cat", "", "12 !", "le chien et le chat " * 50]
    model = langid.Model(["a", "b"], 8, np.log(np.array([0.5, 0.5])), np.log(np.random.default_rng(0).dirichlet(np.ones(256), 2)))
    whole = model.predict(texts)
    single = [model.predict([t]) for t in texts]
    assert whole[0] == [x[0][0] for x in single] and np.allclose(whole[1], [x[1][0] for x in single])


@tables
def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert auc(held["toxic"].to_numpy(), held["score"].to_numpy()) > 0.8
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.03
    train = got[~got["held_out"]]
    assert train[train["toxic"] == 1]["predicted"].mean() > 0.7


def test_machine_learns_a_pair():
    """Label 1 only where both terms meet: no additive weights can tell."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        terms = [k for k, on in ((0, a), (1, b)) if on] + [2 + int(rng.integers(6))]
        rows.append((np.array(terms), np.ones(len(terms))))
        y.append(float(a == b))
    y = np.array(y)
    bias, w, v = toxicity.fit_machine(rows, y, 8, epochs=60, decay=1e-5)
    machine = toxicity.Machine(4, np.arange(16), bias, w, v)
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    z = machine.margin(at, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    assert ((z > 0) == (y == 1)).mean() > 0.95


def test_fit_learns_a_pair_of_neutral_terms(spark):
    """Label 1 where both words or neither are there, among words by chance: no word tells anything alone."""
    rng = np.random.default_rng(5)
    made = []
    for k in range(1500):
        a, b = k % 2, k // 2 % 2  # exactly balanced: log odds of 0
        filler = [f"f{x:03d}" for x in rng.integers(0, 200, 3)]
        made.append((k, " ".join(["aaa"] * (3 * int(a)) + ["bbb"] * (3 * int(b)) + filler), int(a == b)))
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    machine = toxicity.fit(frame.drop("toxic"), frame.filter("doc_id < 1200").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, machine).collect()}
    assert np.mean([(got[k] >= 0.5) == (y == 1) for k, _, y in made[1200:]]) > 0.9


def test_toxicity_odd_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(40)] + [(None, 1, 1), (5000, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    machine = toxicity.fit(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.keep_clean(docs, machine, threshold=2.0).count() == len(rows)
    assert toxicity.keep_clean(docs, machine).columns == docs.columns
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(docs, one).collect()) < 0.01
    assert toxicity.score(none, machine).count() == 0
    # Labels of both kinds, but of no document here: nothing is known, nothing is toxic.
    assert (toxicity.fit(none, labels).score(pa.array(["x", None], pa.string())) < 0.01).all()


@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_toxicity_repeated_rows(spark):
    """A document that comes many times: its terms are its label's best sign, and are counted by its rows."""
    made = [(1, "vile grolm text", 1)] * 40 + [(k, f"plain words number {k}", 0) for k in range(2, 60)]
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    machine = toxicity.fit(frame.drop("toxic"), frame.select("doc_id", "toxic").distinct())
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, machine).collect()}
    assert got[1] > 0.5 and max(x for k, x in got.items() if k != 1) < 0.5


def test_toxicity_sample_is_bounded(spark):
    """Copies of one document train once, texts of one id have a hash each, and the bound in bytes is for each label."""
    made = [(1, "vile grolm text", 1)] * 300 + [(7, f"plain words number {k}", 0) for k in range(600)] + [(k, f"vile grolm {k}", 1) for k in range(1000, 1030)]
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int").repartition(7)
    labels = frame.select("doc_id", "toxic").distinct()
    seen = []
    kept, toxicity.refine = toxicity.refine, lambda rows, y, *a, **k: seen.append(y) or (0.0, np.zeros(1), np.zeros((1, toxicity.FACTORS)))
    try:
        toxicity.fit(frame.drop("toxic"), labels)
        toxicity.fit(frame.drop("toxic"), labels, sample=300)
        toxicity.fit(frame.drop("toxic"), labels, sample_bytes=6000)
    finally:
        toxicity.refine = kept
    assert (seen[0].sum(), len(seen[0])) == (31, 631)
    assert 240 < (seen[1] == 0).sum() < 360
    assert 190 < (seen[2] == 0).sum() < 320 and seen[2].sum() == 31
    # No toxic row fits: the share of toxic rows is all that is known.
    assert abs(toxicity.fit(frame.drop("toxic"), labels, sample_bytes=1).score(pa.array(["x"]))[0] - 330 / 930) < 1e-6


def expected_margin(machine, text):
    """The machine by its formula, with plain loops over words, beginnings and pairs."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    count: dict[int, int] = {}
    for w in words:
        b, at = np.frombuffer(w, np.uint8), np.array([0, len(w)])
        for h in toxicity.term_hashes(b, at)[0]:
            column = int(machine.column_of[int(h) >> (64 - machine.bits)])
            if column >= 0:
                count[column] = count.get(column, 0) + 1
    x = {c: np.log1p(n) / np.sqrt(1 + np.log1p(len(words) / 64.0)) for c, n in count.items()}
    linear = sum(machine.w[c] * v for c, v in x.items())
    pairs = sum(float(machine.v[c] @ machine.v[d]) * x[c] * x[d] for c in x for d in x if c < d)
    return machine.bias + linear + pairs


def test_toxicity_is_its_formula(spark, docs, rows):
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    texts = [r[1] for r in rows if len(r[1] or "") < 2000]
    got = machine.score(pa.array(texts, pa.string()))
    assert np.allclose(got, [1 / (1 + np.exp(-np.clip(expected_margin(machine, t), -30, 30))) for t in texts], atol=1e-9)


@tables
def test_quality_follows_labels(spark):
    got = queries.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    assert got[got["quality"] == 1]["keep"].mean() > 0.97 and got[got["quality"] == 0]["keep"].mean() < 0.15


def test_em_finds_accuracies():
    """Three labellers of known chances for two classes; the rest abstain."""
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.8
    k = len(quality.LABELLERS)
    patterns = np.full(len(y), sum(3**j for j in range(k)))
    hit, miss = (0.9, 0.8, 0.7), (0.02, 0.05, 0.03)
    for j in range(3):
        patterns = patterns - 3**j * (rng.random(len(y)) < np.where(y, miss[j], hit[j]))
    seen, counts = np.unique(patterns, return_counts=True)
    model = quality.fit_weak(seen, counts)
    assert abs(model.good - 0.8) < 0.02
    assert np.allclose(model.chance[0, :3, 0], hit, atol=0.03) and np.allclose(model.chance[1, :3, 0], miss, atol=0.03)


def test_quality_odd_rows(spark, docs, rows, none):
    scorer = quality.fit(docs)
    got = quality.score(docs, scorer).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert quality.score(none, quality.fit(none)).count() == 0


def test_quality_measures_by_python():
    rng = random.Random(1)
    texts = [sentence(rng, 30), "", None, "a a a b", "UP low\nUP low\nx.", "%%% ### ok"]
    from awardlens.llm import _text

    got = {k: v.tolist() for _, _, b, at in _text.chunks(pa.array(texts, pa.string())) for k, v in quality.measures(b, at).items()}
    for k, t in enumerate(texts):
        w = (t or "").split()
        assert got["words"][k] == len(w)
        assert got["distinct"][k] == pytest.approx(len({x.lower() for x in w}) / max(1, len(w)))
        lines = [x for x in (t or "").split("\n") if x]
        assert got["lines"][k] == len(lines)
        assert got["line_again"][k] == pytest.approx(1 - len(set(lines)) / len(lines) if lines else 0)


def test_language_cleaning_is_by_table():
    """Texts are cleaned as the pattern has it, and a few million characters don't take seconds."""
    texts = ["Stra\u00dfe, 12 Uhr; x_y \u00bd!", "", " 12 ", "\u0130stanbul", "\ud800a", "(a)", "a"]
    points, at = langid._points(texts)
    clean = [langid._OTHER.sub(" ", x.lower()).strip(" ") for x in texts]
    assert ["".join(map(chr, points[s:e])) for s, e in zip(at[:-1], at[1:], strict=True)] == [f" {x} " if x else "" for x in clean]
    assert [len(x) for x in langid._points([])] == [0, 1] and [len(x) for x in langid._points(["1"])] == [0, 2]
    began = time.thread_time()
    langid._points([" ".join(["plain", "words", "(or", "7)"] * 10) for _ in range(12_000)])
    assert time.thread_time() - began < 1
