"""The vectorised words and hashes against Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from awardlens.llm import _text

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("abAZ09é漢 \n\t\x0b.,-_")), max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(values):
    for table, pattern in ((_text.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (_text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen: dict[str, int] = {}
        expected = [re.findall(pattern, (v or "").translate(LOW)) for v in values]
        got: list[list[int]] = []
        for _, _, b, at in _text.chunks(pa.array(values, pa.string()), 16):
            h, own = _text.words(b, at, table)
            got += [h[s:e].tolist() for s, e in zip(own[:-1], own[1:], strict=True)]
        assert [len(x) for x in got] == [len(x) for x in expected]
        for a, b in zip(expected, got, strict=True):
            for word, h in zip(a, b, strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_grams():
    h = np.arange(6, dtype=np.uint64)
    assert len(_text.grams(h, 7)) == 0 and len(_text.grams(h, 2)) == 5
    assert _text.grams(h, 3)[1] == _text.grams(h[1:4], 3)[0]
