from __future__ import annotations

import random

import pytest

WORDS = "the of and lorn velt krim oska dant pole wist gora mene tull arve sonn brak ude finn halo".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, start string, component_id string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "or", "ish"]) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and very long ones, repeated rows and equal ids."""
    rng = random.Random(seed)
    passage = sentence(rng, 40)
    texts: list[str | None] = [sentence(rng, rng.randrange(20, 160)) for _ in range(40)]
    for k in range(5):
        texts[k] = f"{texts[k]} {passage} {sentence(rng, 9)}"
    base = texts[10].split()
    for k in range(12):
        near = list(base)
        near[rng.randrange(len(near))] = f"edit{k}"
        texts.append(" ".join(near))
    texts += [texts[11], texts[11].upper(), texts[12]]
    texts += [None, "", "   \n\t", "one", "one two three four", "ONE two three four", "Ünïcode wörds étaient là " * 30, "x" * 300, "a" * 120 + "b" + "a" * 120, "same " * 400, "!!! ??? 123", sentence(rng, 30_000)]
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4 if k % 5 else 0}" if k % 11 else None, len(t or ""), 0.5, "x", "y", "z") for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (21, "another text under an id that is taken", "en", "src1", 3, None, None, None, None), (None, texts[22], None, None, None, None, None, None, None), (None, "no id and words of its own here", None, "src2", None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
