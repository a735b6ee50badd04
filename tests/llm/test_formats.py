"""Token streams, audio, licences and mixing: round trips and brute force."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from awardlens.llm import _text, licenses, media, mixing, pfor, queries, tokens

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=900), st.integers(0, 900), st.integers(0, 900))
def test_blocks_round_trip(values, a, b):
    x = np.array(values, np.uint32)
    image = pfor.encode(x)
    assert (pfor.decode(image) == x).all()
    assert (pfor.Image(image).values(a, b) == x[a:b]).all()


def test_blocks_have_exceptions():
    x = np.arange(1000, 1000 + 256, dtype=np.uint32)
    x[7], x[90] = 4_000_000_000, 5
    image = pfor.Image(pfor.encode(x))
    assert image.least[0] == 5 and len(image.place) == 1 and image.width[0] < 12
    with pytest.raises(ValueError, match="block"):
        pfor.decode(b"x" * 40)


def _encoders():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    return tokens.Encoder(open(queries.vocabulary(), encoding="utf-8").read()), whole


ENCODERS = _encoders()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def encode(encoder, texts):
    return [x for _, _, b, at in _text.chunks(pa.array(texts, pa.string()), 5000) for x in encoder.encode(b, at)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abstmdrevl'' \n\t1,.éÀ×¼")), max_size=25), min_size=1, max_size=5))
def test_split_is_the_pattern(texts):
    encoder, whole = ENCODERS
    assert [x.tolist() for x in encode(encoder, texts)] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


def test_encoder_is_the_library(library, rows):
    encoder = tokens.Encoder(open(queries.vocabulary(), encoding="utf-8").read())
    assert encoder.apart
    odd = ["a\x1cb \x1d c", "x²y ½z", "　　hi", "don't I'LL we'll_ _x__ 12ab34 ", "  a  \n\n b\t\tc ", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>", "<|endoftext|", "|>", "é ü\x85z", "中文 абв 12٣", "", " ", "\n"] + [f"a{chr(c)} b{chr(c)}1 {chr(c)}{chr(c)}-{chr(c)}\n{chr(c)} x" for c in range(0x260)]
    texts = [r[1] or "" for r in rows] + odd
    for got, expected in zip(encode(encoder, texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == expected.ids


def test_encoder_forgets(library, rows, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 50)
    encoder = tokens.Encoder(open(queries.vocabulary(), encoding="utf-8").read())
    for r in rows:
        assert encode(encoder, [r[1] or ""])[0].tolist() == library.encode(r[1] or "", add_special_tokens=False).ids


def test_token_stream(spark, docs, rows, none, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 500)
    tokens.write(docs, f"file://{tmp_path}/ids", queries.vocabulary())
    got = tokens.read(spark, f"file://{tmp_path}/ids", with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    expected = Counter((r[0], (*library.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
    tokens.write(none, f"file://{tmp_path}/none", queries.vocabulary())
    assert tokens.read(spark, f"file://{tmp_path}/none").count() == 0


def decode_one(block):
    """IMA ADPCM, a sample at a time."""
    value, index, out = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(media.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def test_adpcm():
    blocks = np.random.default_rng(0).integers(0, 256, (5, 64)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [decode_one(bytes(b)) for b in blocks]


def test_law_tables():
    # Known points of G.711, and that each table has the code's sign and grows with its magnitude.
    assert media.MU_LAW_PCM[0xFF] == 0 and media.MU_LAW_PCM[0x80] == 32124 and media.MU_LAW_PCM[0x00] == -32124
    assert media.A_LAW_PCM[0xD5] == 8 and media.A_LAW_PCM[0x55] == -8 and media.A_LAW_PCM[0xAA] == 32256 and media.A_LAW_PCM[0x2A] == -32256
    assert len(set(media.A_LAW_PCM.tolist())) == 256 and len(set(media.MU_LAW_PCM.tolist())) == 255


def resample_one(x, rate, to):
    """The filter by its formula, a sample at a time."""
    scale, out = min(1.0, to / rate), []
    half = math.ceil(media.ZEROS / scale)
    for k in range(math.ceil(len(x) * to / rate)):
        at = k * rate / to
        near = [(i, i - at) for i in range(math.floor(at) + 1 - half, math.floor(at) + half + 1)]
        weight = [np.sinc(media.CUTOFF * scale * t) * math.cos(math.pi * t / half / 2) ** 2 for _, t in near]
        out.append(sum(w * int(x[min(max(i, 0), len(x) - 1)]) for (i, _), w in zip(near, weight, strict=True)) / sum(weight))
    return np.array(out)


def tone(hertz, rate, seconds=0.25):
    return np.rint(10_000 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)).astype(np.int16)


@pytest.mark.parametrize("rate,to", [(8000, 16000), (8000, 4000), (8000, 11025), (48000, 8000), (8000, 3000)])
def test_resample(rate, to):
    x = np.random.default_rng(1).integers(-9000, 9000, 701).astype(np.int16)
    got = media.resample(x, rate, to)
    assert len(got) == math.ceil(len(x) * to / rate) and np.abs(got - resample_one(x, rate, to)).max() <= 0.51
    assert (media.resample(np.full(300, -1234, np.int16), rate, to) == -1234).all()
    # A tone that both rates can hold stays; one above the lower rate's half goes.
    keep = media.resample(tone(min(rate, to) * 0.3, rate), rate, to).astype(float)
    known = tone(min(rate, to) * 0.3, to)
    n = min(len(keep), len(known))
    assert np.abs(keep[:n] - known[:n])[200:-200].max() < 120
    if to < rate:
        assert np.abs(media.resample(tone(to * 0.62, rate), rate, to).astype(int))[200:-200].max() < 60
    with pytest.raises(ValueError, match="positive"):
        media.resample(x, rate, 0)
    assert len(media.resample(x[:0], rate, to)) == 0


def features_one(payload, stored):
    """The features of a payload with plain loops."""
    def sound(pcm):
        cross = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        return f"{len(pcm)}/{cross}/{max(map(abs, pcm))}/{math.sqrt(sum(x * x for x in pcm) / len(pcm)):.3f}"

    blocks = [x for k in range(0, len(payload), 576) for x in decode_one(payload[k : k + 576])]
    return "/".join(["7", sound([int(media.MU_LAW_PCM[x]) for x in payload]), sound([int(media.A_LAW_PCM[x]) for x in payload]), sound(blocks), str(zlib.crc32(stored))])


def test_wav_round_trip():
    for codec in (media.MU_LAW, media.A_LAW, media.ADPCM):
        for payload in (b"", b"x", b"y" * 576, b"z" * 577):
            kind, rate, data = media.unpack(media.pack(payload, codec))
            assert (kind, rate) == (codec, 8000) and len(data) % 576 == 0 and len(data) > 0
            assert bytes(data) == payload + b"\xff" * (len(data) - len(payload))


def test_audio(spark, docs, rows, none, tmp_path):
    got = media.digest(media.store(docs, f"file://{tmp_path}/a")).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        w = media.pack(b)
        expected[(r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(w), hashlib.sha256(w).hexdigest())] += 1
    assert Counter(tuple(r)[:7] for r in got) == expected
    by = defaultdict(set)
    for r in got:
        by[r["payload_sha256"]].add(r["feature"])
    assert all(len(x) == 1 for x in by.values())
    stored = spark.read.parquet(f"file://{tmp_path}/a").filter("n_bytes < 3000").collect()
    for r in stored:
        p = bytes(media.unpack(r["media"])[2])
        pcm = media.MU_LAW_PCM[np.frombuffer(p, np.uint8)].astype("<i2").tobytes()
        assert r["pcm"] == pcm
        assert by[hashlib.sha256(p).hexdigest()] == {features_one(p, pcm)}
    low = media.store(docs.filter("n_chars = 3"), f"file://{tmp_path}/b", to=4000).first()
    wide = media.MU_LAW_PCM[np.frombuffer(media.unpack(low["media"])[2], np.uint8)]
    assert low["pcm"] == media.resample(wide, 8000, 4000).astype("<i2").tobytes()
    assert media.digest(media.store(none, f"file://{tmp_path}/n")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_audio_query_stores_every_sample(spark):
    got = {r["doc_id"]: r["feature"] for r in queries.op6_telephony_audio(spark, SF).select("doc_id", "feature").collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) > 0
    for doc_id, text in rows:
        pcm = media.MU_LAW_PCM[np.frombuffer(media.unpack(media.pack((text or "").encode()))[2], np.uint8)]
        assert got[doc_id].split("/")[-1] == str(zlib.crc32(pcm.astype("<i2").tobytes()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_audio_query_resamples(spark):
    """Its features are those of digest, with the stored PCM at 16 kHz before the last one."""
    got = {r["doc_id"]: r["feature"] for r in queries.op6_telephony_audio(spark, SF).select("doc_id", "feature").collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) > 0
    for k, (doc_id, text) in enumerate(rows):
        p = np.frombuffer(media.unpack(media.pack((text or "").encode()))[2], np.uint8)
        pcm = media.MU_LAW_PCM[p]
        wide = media.resample(pcm, 8000, 16000)
        peak, rms = np.abs(wide.astype(int)).max(), math.sqrt((wide.astype(int) ** 2).sum() / len(wide))
        cross = ((wide[1:] < 0) != (wide[:-1] < 0)).sum()
        parts = got[doc_id].split("/")
        assert parts[-6:-1] == [str(2 * len(pcm)), str(cross), str(peak), f"{rms:.3f}", str(zlib.crc32(wide.astype("<i2").tobytes()))]
        if k < 3:
            assert np.abs(wide[:600] - resample_one(pcm[:400], 8000, 16000)[:600]).max() <= 0.51
            assert "/".join([*parts[:-6], parts[-1]]) == features_one(p.tobytes(), pcm.astype("<i2").tobytes())


def scan_one(text):
    """The closest templates of a text's units, by plain loops."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    import re

    plain = re.sub("[^a-z0-9\n]+", " ", low)
    units = {re.sub("[ \n]+", " ", u).strip(" ") for u in [*plain.split("\n"), *re.split("\n *\n", plain), plain]}
    found = []
    for u in units:
        own = {f"{a} {b}" for a, b in zip(u.split(), u.split()[1:], strict=False)}
        if own:
            best = max(((2 * len(own & set(t)) / (len(own) + len(t)), name) for name, t in ((n, licenses.bigrams(x)) for n, x in licenses.TEMPLATES.items())), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            if best[0] >= 0.8:
                found.append(best)
    return found


def test_licenses(spark, docs, rows, none):
    t = licenses.TEMPLATES
    extra = ["Released under the MIT license", "x\n  RELEASED under the mit License!!\ny z", t["MIT-text"], t["MIT-text"][:-30], "Copyright (c) 2020 A\n\n" + t["BSD-3-Clause"].replace(". ", ".\n") + "\n\nmore text", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.\nLicensed under CC BY-SA 4.0.", "license", "a license of our own making", t["GPL-2.0"], t["ISC"].lower() * 2]
    known = docs.select("doc_id", "text", "start", "block").filter("doc_id is not null").unionByName(spark.createDataFrame([(1000 + k, x, None, None) for k, x in enumerate(extra)], "doc_id long, text string, start string, block string"))
    got = licenses.scan(known).collect()
    texts = known.select("doc_id", "text").collect()
    expected = Counter()
    for r in texts:
        found = scan_one(r["text"])
        top = max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]])) if found else (None, None)
        expected[(r["doc_id"], len(found), top[1], None if top[0] is None else round(top[0], 6), ",".join(sorted({n for _, n in found})))] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert sum(1 for r in got if r["n_matches"]) >= 8
    assert licenses.scan(none).count() == 0
    assert {r["n_matches"] for r in licenses.scan(docs, {}).collect()} == {0}


def brute_mix(rows, entropy=mixing.ENTROPY, repeats=mixing.REPEATS, block=mixing.BLOCK_TOKENS, seed=mixing.SEED, budget=None, steps=mixing.STEPS):
    """The mixture by plain loops: (doc_id, source, epoch, start, tokens, copies, block)."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    found: dict[tuple, list] = {}
    for r in rows:
        source = "-" if r[3] is None else f"={r[3]}"
        key = f"{'-' if r[0] is None else r[0]}|{'-' if r[1] is None else md5(r[1])}"
        unit = found.setdefault((source, key), [r[0], 0, 0])
        unit[1] += 1
        unit[2] += len((r[1] or "").split())
    total = Counter()
    for (source, _), u in found.items():
        total[source] += u[2]
    full = {s: t for s, t in total.items() if t}
    if full:
        everything = sum(full.values())
        p = {s: t / everything for s, t in full.items()}
        z = lambda a: sum(x**a for x in p.values())
        h = lambda a: math.log(z(a)) - a * sum(x**a * math.log(x) for x in p.values()) / z(a)
        most = lambda a: (max(p.values()) / min(p.values())) ** (1 - a) if budget is None else min(p.values()) ** (a - 1) / z(a) * budget / everything

        def bisect(holds):
            lo, hi = 0.0, 1.0
            for _ in range(steps):
                lo, hi = ((lo + hi) / 2, hi) if holds((lo + hi) / 2) else (lo, (lo + hi) / 2)
            return lo

        a = 1.0 if h(1.0) >= entropy * math.log(len(p)) else bisect(lambda x: h(x) >= entropy * math.log(len(p)))
        if repeats is not None and most(a) > repeats:
            a = 1.0 if most(1.0) > repeats else bisect(lambda x: most(x) > repeats) + 2.0**-steps
        size = float(budget) if budget is not None else everything * max(p.values()) / (max(p.values()) ** a / z(a))
    out = []
    for source, t in total.items():
        own = [(k, u) for (s, k), u in found.items() if s == source]
        weight = p[source] ** a / z(a) if t else 0.0
        spent = max(1, math.floor(weight * size + 0.5)) if t else 0
        quota = max(1, math.floor(weight * block + 0.5))
        whole = spent // t if t else 0
        for e in range(whole + (spent > whole * t) if t else 1):
            at = e * t
            for nth, (k, u) in enumerate(sorted(own, key=lambda x: (md5(f"{seed}|{e}|{x[0]}"), x[0]))):
                if e < whole or at < spent or not t:
                    out.append((u[0], None if source == "-" else source[1:], e, at, u[2], u[1], at // quota if t else nth // mixing.BLOCK_ROWS))
                at += u[2]
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"budget": 3000, "repeats": None}, {"budget": 90_000, "repeats": 3.0}, {"entropy": 0.5, "repeats": 1.5}])
def test_mixing(docs, rows, none, options, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 4)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    docs, rows = docs.unionByName(docs.sparkSession.createDataFrame(hollow := [(900 + k, " ", None, "hollow", 1, None, None, None, None) for k in range(5)], docs.schema)), rows + hollow
    got = mixing.plan(docs, block_tokens=700, **options).collect()
    expected = brute_mix(rows, block=700, **options)
    assert Counter(tuple(r)[:7] for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["block"]].append(r["position"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())
    times = Counter()
    for (doc_id, source, _, _, _, copies, _), n in expected.items():
        times[(doc_id, source)] += n * copies
    real = mixing.realise(docs, block_tokens=700, **options)
    assert real.columns == docs.columns
    assert Counter((r["doc_id"], r["source"]) for r in real.collect()) == times
    assert mixing.plan(none).count() == 0 and mixing.realise(none).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(k, "w " * 10, None, "big" if k < 700 else f"s{k % 6}", 0) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.plan(df, repeats=None, entropy=0.9).groupBy("source").sum("tokens").collect()
    share = np.array([r[1] for r in got]) / sum(r[1] for r in got)
    assert -(share * np.log(share)).sum() / math.log(7) == pytest.approx(0.9, abs=0.01)
    most = mixing.plan(df, repeats=2.0, entropy=1.0).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert most == 2


def test_mixture_order_reaches_the_stream(spark, tmp_path):
    """Written and read again, rows are in order of block and position; repeats of a document are no neighbours."""
    rows = [(k, f"w{k} " * 10, None, "big" if k < 700 else f"s{k % 6}", 0) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    mixing.realise(df, block_tokens=700).write.parquet(f"file://{tmp_path}/mixed")
    docs = spark.read.parquet(f"file://{tmp_path}/mixed")
    tokens.write(docs, f"file://{tmp_path}/ids", queries.vocabulary(), order=tokens.written_order(docs))
    got = [r["doc_id"] for r in tokens.read(spark, f"file://{tmp_path}/ids").orderBy("start").collect()]
    planned = mixing.plan(df, block_tokens=700).orderBy("block", "position").collect()
    assert got == [r["doc_id"] for r in planned]
    assert max(Counter(got).values()) == 2 and not any(a == b for a, b in zip(got, got[1:], strict=False))
    # Sources are mixed in each block: none is over its weight by more than a document or two.
    first = [r["source"] for r in planned if r["block"] == 0]
    assert len(set(first)) == 7
    assert tokens.written_order(df) == []
