"""Task, cache and gauge metrics, and merging of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions.keys import deadline_class


def exact_sum(value: Column) -> Column:
    """Sum of durations that does not depend on the order of addition.

    Durations are differences of clocks that count microseconds.
    """
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def duration_histogram(tasks: DataFrame, label: str, seconds: str = "seconds") -> DataFrame:
    """Cumulative buckets per label, with count and sum; one shuffle of one row per label."""
    bounds = [(str(b), F.lit(float(b))) for b in settings.DURATION_BUCKETS] + [("+Inf", None)]
    value = F.col(seconds)
    counts = [
        F.count_if(value <= bound if bound is not None else value.isNotNull()).alias(f"le_{i}")
        for i, (_, bound) in enumerate(bounds)
    ]
    wide = tasks.groupBy(label).agg(
        *counts, F.count(value).alias("total_count"), exact_sum(value).alias("total_seconds")
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("le"), F.col(f"le_{i}").alias("observations"))
        for i, (name, _) in enumerate(bounds)
    ])
    return wide.select(label, F.explode(rows).alias("b"), "total_count", "total_seconds").select(
        label, "b.le", "b.observations", "total_count", "total_seconds"
    )


def task_counters(attempts: DataFrame) -> DataFrame:
    """Completed, failed, timed-out and retried attempts and cache lookups per task name."""
    return attempts.groupBy("task_name").agg(
        F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") != "success").alias("failures"),
        F.count_if(F.col("seconds") > settings.HARD_LIMIT_SECONDS).alias("timeouts"),
        F.count_if(F.col("attempt") > 0).alias("retries"),
        F.count_if(F.col("cache_hit")).alias("hits"),
        F.count_if(~F.col("cache_hit")).alias("misses"),
    )


def cache_hit_counts(accesses: DataFrame) -> DataFrame:
    """Hits and misses, kept apart by cache type."""
    return accesses.groupBy("cache_type").agg(
        F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )


def warning_counts(lint_rows: DataFrame) -> DataFrame:
    return lint_rows.groupBy("type").agg(F.count("*").alias("warnings"))


def gauge_last(points: DataFrame) -> DataFrame:
    """Last set value per gauge and label."""
    when = F.struct("ts", "event_id")
    return points.groupBy("metric", "label").agg(F.max_by("value", when).alias("value"))


def metrics_snapshot(attempts: DataFrame, gauges: DataFrame, gauge_of: dict[str, str]) -> DataFrame:
    """One row of named values, zero where nothing was recorded.

    `gauge_of` maps an output column to the gauge it shows. Both inputs are
    brought to one shape, so the row is one partial aggregate of one pass.
    """
    none = F.lit(None)
    rows = attempts.select(
        "status", "cache_hit", none.cast("string").alias("metric"), none.cast("double").alias("value"),
        none.cast("timestamp_ntz").alias("ts"), none.cast("long").alias("event_id"),
    ).unionByName(gauges.select(
        none.cast("string").alias("status"), none.cast("boolean").alias("cache_hit"),
        "metric", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id",
    ))
    when = F.struct("ts", "event_id")
    shown = [
        F.coalesce(
            F.max_by("value", F.when(F.col("metric") == gauge, when)), F.lit(0.0)
        ).alias(name)
        for name, gauge in gauge_of.items()
    ]
    return rows.agg(
        F.count_if(F.col("status") == "success").alias("tasks_completed"),
        F.count_if(F.col("status") == "error").alias("tasks_failed"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        *shown,
    )


def task_deadlines(attempts: DataFrame) -> DataFrame:
    """Duration of each attempt and the limit it broke."""
    seconds = (F.unix_micros(F.col("done").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    timed = attempts.select("event_id", "task", seconds.alias("duration"))
    return timed.withColumn("deadline", deadline_class(F.col("duration")))


def attempt_rollup(attempts: DataFrame, max_retries: int = settings.MAX_RETRIES) -> DataFrame:
    """Per task the status of its last counted attempt and its retries.

    Attempts are numbered from 0; those past the allowed retries never ran.
    """
    ran = attempts.filter(F.col("attempt") <= max_retries)
    return ran.groupBy("task").agg(
        F.max_by("status", "attempt").alias("status"), (F.count("*") - 1).alias("retries")
    )


def merge_results(partials: DataFrame, ok_statuses=("SUCCESS", "COMPLETED")) -> DataFrame:
    """Merged result maps, last entry per key, with failed parts listed as they are.

    Long rows instead of one map and one list per project: a project may have
    any number of entries. `kind` tells result entries from errors.
    """
    ok = F.col("status").isin(list(ok_statuses))
    entries = partials.filter(ok).select("project", "ord", F.explode("result").alias("key", "value"))
    merged = entries.groupBy("project", "key").agg(F.max_by("value", "ord").alias("value"))
    results = merged.select("project", F.lit("result").alias("kind"), "key", "value")
    errors = partials.filter(~ok).select(
        "project", F.lit("error").alias("kind"), F.col("ord").cast("string").alias("key"),
        F.col("error").alias("value"),
    )
    return results.unionByName(errors)


def latest_results(stored: DataFrame, current_version: int = settings.CACHE_VERSION) -> DataFrame:
    """Last written value per key; keys of other versions are not visible.

    `stored_at` and `event_id` name the write that won.
    """
    visible = stored.filter(F.col("version") == current_version)
    when = F.struct("ts", "event_id")
    won = visible.groupBy("key").agg(F.max_by(F.struct("data", "ts", "event_id"), when).alias("w"))
    return won.select("key", "w.data", F.col("w.ts").alias("stored_at"), "w.event_id")


def live_results(results: DataFrame, now: Column, ttl_seconds: int = settings.RESULT_TTL_SECONDS) -> DataFrame:
    """Stored results whose life has not ended at `now`."""
    ends = F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col("stored_at"))
    return results.filter(ends >= now)
