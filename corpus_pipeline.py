"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Each stage takes what its predecessor kept, whole. The first four return the columns of documents: without toxic
documents; with the first document of each group of near copies; without documents that hold a window of the
benchmark; and each as often as its source's weight in the mixture asks for, at least once by the default budget, in
the order of the mixture's blocks. The last writes the token ids in the order of its input's files, which is that order,
and returns, for each document of the stream, its place, size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from awardlens.llm import _store, decontaminate, jaccard, mixing, tokens, toxicity
from awardlens.llm.queries import _fold, _table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model scores 0.5 or more; it learns from the labelled ones of its input."""
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), usable=_fold("_id", 5) != 0)
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, repeated as the weights of the sources ask for, sorted by the mixture's block and position."""
    return mixing.realise(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the written token stream, which keeps the order that docs was written in."""
    path = _store.place(spark, "token-ids")
    tokens.write(docs, path, vocabulary(), order=tokens.written_order(docs))
    return tokens.read(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]
#: Trained models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = _store.place(spark, f"pipeline-{k + 1}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
