"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, decontaminate, jaccard, langid, licenses, media, mixing, quality, repeats, sql, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: the path of a tokenizers file, by default the byte-level one of the installed vocabularies."""
    path = _store.place(spark, "token-ids")
    tokens.write(_table(spark, sf_dir, "documents"), path, tokenizer or vocabulary())
    return tokens.read(spark, path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score. A null doc_id is in the training part, as its fold isn't known to be 1."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, usable=F.coalesce(_fold("doc_id", 3) != 1, F.lit(True)))
    return langid.predict(docs, model).select("doc_id", F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PCM is stored at the decoded rate, 8 kHz, every sample of it; read back, it is brought to 16 kHz for the features."""
    return media.digest(media.store(_table(spark, sf_dir, "documents"), _store.place(spark, "telephony")), to=media.WIDE)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, usable=_fold("_id", 5) != 0)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_token_ids": op3_token_ids,
    "op4_language_id": op4_language_id,
    "op5_licenses": op5_licenses,
    "op6_telephony_audio": op6_telephony_audio,
    "op7_repeats": op7_repeats,
    "op8_jaccard": op8_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}

#: Trained models, tokenizers, audio, and the removal of bytes have no SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
