"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolot.llm import class_lm, exact_dedup, language_id, line_frequency, mixing, near_dedup, packing, pieces, quality_classifier, toxicity
from kolot.llm.common import Workspace, fold, table, text_or_empty


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_classifier.score(F.col("text"), model, spark).alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return scored.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the id matrices that it writes to the shared folder."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.rows_of(packing.write_matrices(packed, f"{Workspace(spark, 'packing').path}/matrices"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    scored = class_lm.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_rules(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(text_or_empty("text"), model, spark).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_toxicity, op3_packing, op4_class_lm, op5_line_frequency, op6_exact_dedup, op7_language_id, op8_sentencepiece, op9_mix_sources, op10_minhash)
}

ORACLES: dict[str, str] = {
    "op5_line_frequency": line_frequency.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_language_id": language_id.ORACLE,
    "op10_minhash": near_dedup.ORACLE,
}
