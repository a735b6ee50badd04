"""The pipeline's stages, each on what its predecessor kept."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from awardlens.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    from awardlens.llm import decontaminate, jaccard, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        out = stage(spark, docs, SF)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append((before, docs))
        if k < 4:
            assert docs.columns == columns
    ids = [({r[0] for r in a.select("doc_id").collect()}, {r[0] for r in b.select("doc_id").collect()}) for a, b in seen]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.fit(seen[0][0], labels, usable=queries._fold("_id", 5) != 0)
    assert ids[0][1] == {r["doc_id"] for r in toxicity.score(seen[0][0], machine).collect() if r["score"] < 0.5}
    assert ids[1][1] == {r["component_id"] for r in jaccard.classes(seen[1][0]).collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[2][1] == {r["doc_id"] for r in decontaminate.contamination(seen[2][0], bench).collect() if not r["contaminated"]}
    assert ids[3][1] == ids[2][1] == ids[4][1]
    stream = seen[4][1].orderBy("start").collect()
    assert len(stream) == seen[3][1].count()
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(stream, stream[1:], strict=False))
    # The stream is the mixture: by block, and by position within it.
    planned = [r["doc_id"] for r in mixing.plan(seen[2][1]).orderBy("block", "position").collect()]
    assert [r["doc_id"] for r in stream] == planned
    assert Counter(planned) == Counter(r["doc_id"] for r in seen[3][1].collect())


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_odd_rows(spark, docs, none, tmp_path, some):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns with the operators' own names."""
    clashing = ["row", "unit", "__fp", "__id", "__mix_source", "_id", "_t", "h", "sig", "again", "a.b", "score2"]
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None)]
    sf = f"file://{tmp_path}/{some}"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "one two three four"), (4, " ".join("abcdefghijkl"))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = docs if some else none
    now = now.select("*", *(F.lit(7).alias(c) for c in clashing))
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        if k < 4:
            assert now.columns == columns
            if some:
                assert now.filter(" or ".join(f"`{c}` <> 7 or `{c}` is null" for c in clashing)).count() == 0 < now.count()
    rows = now.orderBy("start").collect()
    assert (len(rows) > 0) == some
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))


def test_registry():
    assert [n for n in queries.QUERIES] == ["op1_quality", "op2_mixing", "op3_token_ids", "op4_language_id", "op5_licenses", "op6_telephony_audio", "op7_repeats", "op8_jaccard", "op9_toxicity", "op10_decontamination"]
    assert len(corpus_pipeline.STAGES) == 5
