"""Corpora that already are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A stored files table: project, path, ext, size, content."""
    return spark.read.parquet(path).select("project", "path", "ext", "size", "content")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly row-wise work on few input splits.

    A table of one small file is one task, however many cores there are. Such
    a table is shuffled by a unique key; one that already has as many splits
    as the cluster has cores stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, key)
