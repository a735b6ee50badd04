"""Near copies, repeated passages and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from awardlens.llm import components, decontaminate, jaccard, repeats

from .test_text import LOW


def sets(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOW))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def roots(rows):
    """The sets, and a row of each row's component."""
    own = sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                parent[find(i)] = find(j)
    return own, [find(i) for i in range(len(rows))]


def expected_components(rows):
    own, root_of = roots(rows)
    least: dict[int, int | None] = {}
    for i, r in enumerate(rows):
        root = root_of[i]
        known = [x for x in (least.get(root), r[0]) if x is not None]
        least[root] = min(known) if known else None
    return Counter((r[0], len(own[i]), least[root_of[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("length", [64, 2])
def test_jaccard(spark, docs, rows, monkeypatch, length):
    monkeypatch.setattr(jaccard, "LIST", length)
    got = Counter(tuple(r) for r in jaccard.classes(docs).collect())
    assert got == expected_components(rows)


def test_jaccard_keeps_one(docs, rows, none):
    kept = jaccard.keep_one(docs).collect()
    groups = expected_components(rows)
    assert kept[0].asDict().keys() == set(docs.columns)
    ids = Counter(r["doc_id"] for r in kept)
    assert all(ids[c] >= 1 for c in {k[2] for k in groups if k[1]} if c is not None)
    # One of every component with words, and all documents without words.
    own, root_of = roots(rows)
    words = [r for r in kept if (r["text"] or "").strip()]
    assert len(words) == len({x for x, s in zip(root_of, own, strict=True) if s})
    assert sum(1 for r in kept if not (r["text"] or "").strip()) == sum(1 for s in own if not s)
    assert jaccard.keep_one(none).count() == 0 and jaccard.classes(none).count() == 0


def test_linked_at_the_bound(spark):
    """Sets of 9 and 10 shingles that share 8, 9: 80 hundredths and less."""
    words = [f"w{k}" for k in range(30)]
    a = " ".join(words[:13])
    near, far = " ".join(words[:12] + ["x"]), " ".join(words[:11] + ["x", "y"])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame([(1, a), (2, near), (3, far)], "doc_id long, text string")).collect()}
    # 8 of 10 shingles link 1 and 2; 1 and 3 share 7 of 11; 2 and 3 share 7 of 11.
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_repeats(rows):
    least = -(1 << 63)
    first: dict[bytes, tuple] = {}
    own = [((least if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    for key, b in own:
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            first[w] = min(first.get(w, (key, k)), (key, k))
    out = Counter()
    for (key, b), r in zip(own, rows, strict=True):
        covered = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (key, k):
                covered[k : k + 100] = b"\1" * 100
        runs = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[(r[0], len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_row_holds_the_first_passage(spark, parts):
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(1, f"one before {passage}"), (1, f"one before {passage}"), (2, f"another start, {passage} and an end"), (3, "own " + passage[:150])]
    got = Counter(tuple(r) for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())
    assert got == expected_repeats(rows)


def test_repeats(docs, rows, none):
    got = Counter(tuple(r) for r in repeats.digest(docs).collect())
    assert got == expected_repeats(rows)
    assert repeats.digest(none).count() == 0


@pytest.mark.parametrize("modulus", [1, 7, 1 << 40])
def test_repeats_by_shuffle(docs, rows, monkeypatch, modulus):
    """Every gram a trigger, some, and none; classes over several batches; texts in pieces."""
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(repeats, "MODULUS", modulus)
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "ROWS", 3)
    monkeypatch.setattr(repeats, "WINDOWS", 20)
    monkeypatch.setattr(repeats, "_PIECE", 700)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert Counter(tuple(r) for r in repeats.digest(docs).collect()) == expected_repeats(rows)
    finally:
        docs.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("turn", [1, -1])
def test_repeats_tie(spark, turn):
    """Two texts of one id share a passage at one place: neither starts earlier. A later document loses it."""
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(1, f"{passage} one end"), (1, f"{passage} and another"), (2, f"x {passage}")][::turn]
    got = Counter(tuple(r) for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == expected_repeats(rows) and sum(r[2] > 0 for r in got) == 1


def test_hot_parts_cover():
    for around in (0, 1, 2, 5, 38, 39):
        assert sorted(x for p, q in repeats._parts(around) for x in range(p, q + 1)) == list(range(around + 1))


def test_parse_is_of_the_window_alone():
    """A window's core and its place follow from its bytes, wherever it stands."""
    rng = np.random.default_rng(3)
    inner = rng.integers(97, 100, 300).astype(np.uint8)
    found = []
    for lead in (0, 17, 211):
        b = np.concatenate([rng.integers(97, 100, lead).astype(np.uint8), inner, rng.integers(97, 100, 90).astype(np.uint8)])
        _, lo, hi, g, h = repeats.parse(b, np.array([0, len(b)]))
        assert (hi - lo + 1).sum() == len(b) - 99 and (g >= hi).all() and (g + 62 <= lo + 100).all()
        own = {int(w): (int(x - w), int(y)) for s, e, x, y in zip(lo, hi, g, h, strict=True) for w in range(s, e + 1)}
        found.append([own[lead + k] for k in range(201)])
    assert found[0] == found[1] == found[2]


ITEMS = [(0, "w1 w2 w3"), (1, None), (2, ""), (3, "Lonely"), (None, "no id item words"), (4, "same same same same same same same same same same same")]


def windows(items):
    out = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        for k in range(max(1, len(w) - 9)) if w else []:
            out[tuple(w[k : k + 10])].add("" if i is None else str(i))
    return out


def expected_hits(rows, items):
    known = windows(items)
    out = Counter()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for m in {len(x) for x in known}:
            for k in range(len(w) - m + 1):
                if names := known.get(tuple(w[k : k + m])):
                    found |= names
                    hit[k : k + m] = [1] * m
        out[(r[0], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))] += 1
    return out


def test_decontamination(spark, docs, rows, none):
    texts = [r[1] for r in sorted(rows, key=lambda r: (r[0] is None, r[0])) if r[1]]
    items = [*ITEMS, (5, " ".join(texts[3].split()[4:30])), (6, texts[7].upper()), (7, "one two three four"), (7, "one two three four"), (8, " ".join(texts[3].split()[10:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r)[:6] for r in decontaminate.contamination(docs, bench).collect())
    assert got == expected_hits(rows, items)
    kept = decontaminate.decontaminate(docs, bench)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k: n for k, n in Counter(x[0] for x in expected_hits(rows, items).elements() if not x[5]).items()})
    assert kept.columns == docs.columns
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    # A benchmark in parts gives the same rows.
    whole = Counter(str(tuple(r)) for r in decontaminate.contamination(docs, bench).collect())
    assert Counter(str(tuple(r)) for r in decontaminate.contamination(docs, bench, max_bytes=300).collect()) == whole
    assert Counter(r["doc_id"] for r in decontaminate.decontaminate(docs, bench, max_bytes=300).collect()) == Counter(r["doc_id"] for r in kept.collect())
    assert Counter(map(tuple, decontaminate.longest_matches(docs, bench, max_bytes=300).collect())) == Counter(map(tuple, decontaminate.longest_matches(docs, bench).collect()))


def test_decontamination_in_small_shards(docs, spark, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 400)
    items = [*ITEMS, (5, " ".join(next(r[1] for r in rows if r[0] == 3).split()[4:40]))]
    got = Counter(tuple(r)[:6] for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == expected_hits(rows, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=5), st.integers(1, 6))
def test_suffix_array_and_search(texts, items, window):
    """The array has every suffix in order; every occurrence is found, by brute force."""
    column = pa.array([" ".join(t) for t in texts], pa.string())
    index = decontaminate.Index([(k, " ".join(t)) for k, t in enumerate(items)], window)
    found = set()
    for i, j, shard in decontaminate._pieces(column, window):
        order = [[int(x) for x in shard.number[p : shard.own[np.searchsorted(shard.own, p, side="right")]]][:window] for p in shard.array]
        assert sorted(shard.array.tolist()) == list(range(len(shard.number))) and order == sorted(order)
        doc, place, pattern = shard.search(index)
        found |= {(i + d, p, k, q) for d, p, k, q in zip(*decontaminate._expand(index, doc, place, pattern), strict=True)}
    expected = set()
    for k, t in enumerate(items):
        n = min(window, len(t))
        for q in range(len(t) - n + 1) if n else []:
            expected |= {(d, p, k, q) for d, x in enumerate(texts) for p in range(len(x) - n + 1) if x[p : p + n] == t[q : q + n]}
    assert found == expected


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x " * 3 + " ".join(f"w{k}" for k in range(25)) + " y"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(5, 40)))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()] == [(1, "9", 8, 0, 20)]
