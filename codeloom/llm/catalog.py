"""The queries of this subpackage: (session, folder) to the contract's rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    bpe, burst_trie, chat, decontam, html_text, language, lines, lm, neardup, pii, quality, toxicity, whitening,
)
from codeloom.llm.text import documents, residue


def vocabulary_path() -> str:
    """The word-level vocabulary: WORD_BPE_PATH, or the file of the public tokenizers package."""
    named = os.environ.get("WORD_BPE_PATH")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(documents(spark, folder))


def language_profiles(docs: DataFrame, keep=None) -> language.Profiles:
    """Profiles learned from labelled rows; `keep` is a condition on the rows learned from."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if keep is not None:
        labelled = labelled.where(keep)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    return language.learn_profiles(labelled.select("text", "lang", pick.alias("pick")))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    profiles = language_profiles(docs, residue(3) != 1)
    held_out = F.coalesce(residue(3) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    return language.identify(rows, profiles).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), vocabulary_path())


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    rest = residue(7)
    return lm.scores(documents(spark, folder), rest != 2, F.coalesce(rest == 2, F.lit(False)))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    lexicon = toxicity.learn(docs, labels.where(residue(3) != 1))
    return toxicity.toxicity(docs, lexicon, F.coalesce(residue(3) == 1, F.lit(False)))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(spark.read.parquet(f"{folder}/conversations.parquet"))


def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.line_dedup(documents(spark, folder).select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder))


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    return burst_trie.trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def op12_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_language_model": op5_language_model,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_lines": op9_lines,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_trie": op11_trie,
    "op12_html": op12_html,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_quality": quality.SQL,
    "op6_decontamination": decontam.SQL,
    "op8_chat": chat.SQL,
    "op9_lines": lines.SQL,
    "op10_near_duplicates": neardup.SQL,
    "op11_trie": burst_trie.SQL,
    "op12_html": html_text.SQL,
}
