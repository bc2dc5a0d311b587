"""Column expressions for result keys, lifetimes and deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import settings


def path_hash(path: Column) -> Column:
    hashed = F.sha2(path, 256)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(hashed)


def result_key(path: Column, project: Column | None = None,
               version: int = settings.CACHE_VERSION) -> Column:
    """`analysis_v2[:project]:sha256(path)`; an empty project is left out."""
    prefix = F.lit(f"analysis_v{version}")
    plain = F.concat(prefix, F.lit(":"), path_hash(path))
    if project is None:
        return plain
    scoped = F.concat(prefix, F.lit(":"), project, F.lit(":"), path_hash(path))
    return F.when(F.coalesce(project, F.lit("")) == "", plain).otherwise(scoped)


def key_version(key: Column) -> Column:
    return F.regexp_extract(key, r"^analysis_v(\d+):", 1).try_cast("int")


def key_project(key: Column) -> Column:
    """Project part of a scoped key, empty for a key without one."""
    return F.regexp_extract(key, r"^analysis_v\d+:(.*):[0-9a-f]*$", 1)


def ttl_seconds(size: Column) -> Column:
    return F.when(size < settings.BIG_PROJECT_BYTES, F.lit(settings.RESULT_TTL_SECONDS)).otherwise(
        F.lit(settings.BIG_PROJECT_TTL_SECONDS)
    )


def needs_partitioning(size: Column) -> Column:
    return size > settings.PARTITION_BYTES


def deadline_class(seconds: Column) -> Column:
    return (
        F.when(seconds > settings.HARD_LIMIT_SECONDS, F.lit("hard"))
        .when(seconds > settings.SOFT_LIMIT_SECONDS, F.lit("soft"))
        .otherwise(F.lit("ok"))
    )


def unit_point(text: Column) -> Column:
    """A repeatable number in [0, 1) drawn from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
