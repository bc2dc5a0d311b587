"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written
and read again as the next one's documents. All but the last return the columns
they got. Every stage works on whatever the one before kept and on nothing else.

Null texts and texts without letters leave at the first stage; a row without an
id can be no duplicate and no match, and stays. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontam, language, lines, neardup
from codeloom.llm.catalog import language_profiles, vocabulary_path
from codeloom.llm.sizes import small_enough
from codeloom.llm.text import documents, packed_row
from codeloom.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents in which no language is found."""
    return language.speaking(docs, language_profiles(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Take each source's boilerplate lines out of its documents; no document goes."""
    packed = docs.select(packed_row(docs), "source", "text")
    cut = lines.line_dedup(packed)

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            length = F.length("text").cast(docs.schema[name].dataType)
            return F.when(F.col("n_dropped") > 0, length).otherwise(old).alias(name)
        return old.alias(name)

    return cut.select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    found = neardup.near_duplicates(docs)
    extra = cut_lineage(found.where(~F.col("kept")).select(F.col("doc_id").alias("_extra")).distinct(), "extra")
    side = F.broadcast(extra) if small_enough(extra) else extra
    return docs.join(side, docs["doc_id"].cast("long") == side["_extra"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return bpe.digests(docs, vocabulary_path(), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe_encoding),
]

# Language profiles, MinHash components and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of `folder`, each written before the next reads it."""
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
