"""Streaming twins of the access, result and event operators.

Every stream runs with `availableNow`: an outside scheduler starts it as often
as wanted, and it goes on where it stopped. Output and checkpoint live below
one folder. Every micro-batch writes what it alone says of each key into
`batch=<id>`, so a batch that is run again after a failure overwrites its own
files only, no state grows in the stream, and the order of files plays no part.
A snapshot function merges the parts; `compact` merges those of old batches into
one, so that a snapshot does not read every batch there ever was.

The streams at the end of this module keep state instead, and their snapshots read it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from codeloom import settings
from codeloom.operators import access, matching, metrics

LATENESS = "10 minutes"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; the schema is that of the table now."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(folder)


def folder_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder, some per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _start(df: DataFrame, out: str, mode: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(each).trigger(availableNow=True).start()
    )


def _keep_parts(out: str, part: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    return write


def _parts(spark: SparkSession, out: str) -> DataFrame:
    """The newest compacted part and those of the batches after it."""
    rows = spark.read.parquet(f"{out}/data")
    upto, files = _compacted(spark, out)
    if upto is None:
        return rows.drop("batch")
    later = rows.filter(F.col("batch") > upto).drop("batch")
    return later.unionByName(spark.read.schema(later.schema).parquet(files))


def _compacted(spark: SparkSession, out: str) -> tuple[int | None, str]:
    """The last batch in the newest finished compaction, and its folder."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/compacted")
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(base):
        return None, ""
    done = [int(x.getPath().getName().removeprefix("upto=")) for x in system.listStatus(base)
            if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return (max(done), f"{out}/compacted/upto={max(done)}") if done else (None, "")


def compact(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge all parts so far into one; `merge` is the stream's own merge. Run it between two runs of the stream."""
    newest = spark.read.parquet(f"{out}/data").agg(F.max("batch")).first()[0]
    if newest is not None:
        merge(_parts(spark, out)).write.mode("overwrite").parquet(f"{out}/compacted/upto={newest}")


def event_fanout(events: DataFrame, subscriptions: list[dict], out: str) -> StreamingQuery:
    """Deliveries of events to their subscribers, into a file sink."""
    return (
        matching.event_fanout(events, subscriptions).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/data")
        .trigger(availableNow=True).start()
    )


def merge_last_access(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(F.max("last_ts").alias("last_ts"))


def last_access(accesses: DataFrame, out: str) -> StreamingQuery:
    """Newest access per key."""
    def part(batch: DataFrame) -> DataFrame:
        return batch.groupBy("key").agg(F.max("ts").alias("last_ts"))

    return _start(accesses, out, "append", _keep_parts(out, part))


def last_access_snapshot(spark: SparkSession, out: str) -> DataFrame:
    return merge_last_access(_parts(spark, out))


def minute_counts(accesses: DataFrame, out: str, lateness: str = LATENESS) -> StreamingQuery:
    """Accesses, hits and misses per minute; state older than the watermark is dropped."""
    timed = accesses.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counts = timed.groupBy(F.window("at", "1 minute"), "cache_type").agg(
        F.count("*").alias("accesses"),
        F.count_if(F.col("hit")).alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
    )
    flat = counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("minute"), "cache_type", "accesses", "hits", "misses"
    )
    return _start(flat, out, "update", _keep_parts(out, lambda batch: batch))


def minute_counts_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """Of every minute the row of the last batch that updated it."""
    rows = spark.read.parquet(f"{out}/data")
    keys = ["minute", "cache_type"]
    values = [c for c in rows.columns if c not in {*keys, "batch"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(F.sum("accesses").alias("accesses"))


def access_counts(accesses: DataFrame, out: str) -> StreamingQuery:
    """Accesses per key."""
    def part(batch: DataFrame) -> DataFrame:
        return batch.groupBy("key").agg(F.count("*").alias("accesses"))

    return _start(accesses, out, "append", _keep_parts(out, part))


def popular_snapshot(spark: SparkSession, out: str, k: int) -> DataFrame:
    """The list an hourly refresh would warm up: the k most accessed keys."""
    return merge_counts(_parts(spark, out)).orderBy(F.col("accesses").desc(), "key").limit(k)


def compute_points(accesses: DataFrame, out: str) -> StreamingQuery:
    """Accesses by key and time, for `compute_points_snapshot`.

    Which access computes depends on all before it, and files may come in any
    order, so it is decided when it is asked for, over all of them.
    """
    def part(batch: DataFrame) -> DataFrame:
        return batch.select("key", "ts").distinct()

    return _start(accesses, out, "append", _keep_parts(out, part))


def merge_accesses(parts: DataFrame) -> DataFrame:
    return parts.distinct()


def compute_points_snapshot(spark: SparkSession, out: str,
                            ttl_seconds: int = settings.RESULT_TTL_SECONDS) -> DataFrame:
    """Accesses that have to compute, as the batch operator finds them."""
    return access.compute_points(_parts(spark, out), ttl_seconds)


def ttl_points(accesses: DataFrame, out: str, ttl_seconds: int = settings.RESULT_TTL_SECONDS,
               lateness: str = LATENESS) -> StreamingQuery:
    """Accesses that have to compute, found as they come: key and time in microseconds, appended to a file sink.

    The state of a key is the time of its last computing access. An access up to
    the TTL after it reuses the result and does not extend its life; so does one
    that comes late and is older. State goes once the watermark has passed the end
    of the life, so there is no more of it than keys with a living result; a result
    is never asked for by rows behind the watermark, which are dropped. Times of a
    key are gathered per micro-batch, whose size the source bounds.
    """
    ttl = int(ttl_seconds * access.MICROS)

    # Nested, so that it is shipped by value and executors need no copy of us.
    def reuse(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = np.unique(np.concatenate([np.unique(b["t"].to_numpy()) for b in batches]))
        last = state.get[0] if state.exists else None
        at, found = (0 if last is None else int(np.searchsorted(times, last + ttl, side="right"))), []
        while at < len(times):
            last = int(times[at])
            found.append(last)
            at = int(np.searchsorted(times, last + ttl, side="right"))
        state.update((last,))
        state.setTimeoutTimestamp((last + ttl) // 1000 + 1)
        if found:
            yield pd.DataFrame({"key": key[0], "t": found})

    t = access.micros_of(F.col("ts"))
    timed = (accesses.select("key", t.alias("t")).withColumn("at", F.timestamp_micros("t"))
             .withWatermark("at", lateness))
    points = timed.groupBy("key").applyInPandasWithState(
        reuse, "key string, t long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return (points.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())


def ttl_points_written(spark: SparkSession, out: str) -> DataFrame:
    """What `ttl_points` has found so far."""
    return spark.read.parquet(f"{out}/data")


def latest_results(stored: DataFrame, out: str,
                   current_version: int = settings.CACHE_VERSION) -> StreamingQuery:
    """Last written value per key: each batch adds its own winners."""
    def part(batch: DataFrame) -> DataFrame:
        return metrics.latest_results(batch, current_version)

    return _start(stored, out, "append", _keep_parts(out, part))


def merge_latest(parts: DataFrame) -> DataFrame:
    when = F.struct("stored_at", "event_id")
    won = parts.groupBy("key").agg(F.max_by(F.struct("data", "stored_at", "event_id"), when).alias("w"))
    return won.select("key", "w.*")


def latest_results_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The newest winner of each key over all batches."""
    return merge_latest(_parts(spark, out))


# ---- what is asked for is the state of the query, so no part of any batch is read again ----

def _keep_state(aggregated: DataFrame, out: str) -> StreamingQuery:
    """Run an aggregation for its state alone; nothing is written but the checkpoint."""
    return (
        aggregated.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def _state(spark: SparkSession, out: str) -> DataFrame:
    """Grouping columns and the value (`kept`) of an aggregation of one value, as of the last finished batch."""
    rows = spark.read.format("statestore").load(f"{out}/checkpoint")
    value = rows.schema["value"].dataType.names[0]
    return rows.select("key.*", F.col("value").getField(value).alias("kept"))


def live_results_kept(stored: DataFrame, out: str, current_version: int = settings.CACHE_VERSION,
                      ttl_seconds: int = settings.RESULT_TTL_SECONDS, lateness: str = LATENESS) -> StreamingQuery:
    """Newest write per key, for `live_results_of_state`; what is superseded or has expired leaves the state.

    State holds one row per key and stretch of one TTL. The watermark follows the
    newest write by the TTL and the lateness, so a stretch goes only once each
    write in it has expired: two stretches and the lateness are kept, in whatever
    order the files come. Of equal times the later event wins. Rows without a
    time are left out, as they never expire.
    """
    at = F.timestamp_micros(access.micros_of(F.col("ts")))
    delay = f"{ttl_seconds} seconds {lateness}"
    timed = stored.withColumn("at", at).withWatermark("at", delay).filter(F.col("version") == current_version)
    newest = timed.groupBy("key", F.window("at", f"{ttl_seconds} seconds")).agg(
        F.max(F.struct("ts", "event_id", "data")).alias("newest"))
    return _keep_state(newest, out)


def live_results_of_state(spark: SparkSession, out: str, now: Column,
                          ttl_seconds: int = settings.RESULT_TTL_SECONDS) -> DataFrame:
    """Results still alive at `now`, which is no earlier than the newest write, as the batch operator finds them."""
    won = _state(spark, out).groupBy("key").agg(F.max("kept").alias("w"))
    newest = won.select("key", "w.data", F.col("w.ts").alias("stored_at"), "w.event_id")
    return metrics.live_results(newest, now, ttl_seconds)


def counts_kept(accesses: DataFrame, out: str) -> StreamingQuery:
    """Accesses per key; the state is one number for each key there is."""
    return _keep_state(accesses.groupBy("key").agg(F.count("*").alias("accesses")), out)


def popular_of_state(spark: SparkSession, out: str, k: int) -> DataFrame:
    """The k most accessed keys."""
    counts = _state(spark, out).withColumnRenamed("kept", "accesses")
    return counts.orderBy(F.col("accesses").desc(), "key").limit(k)


def minute_counts_closed(accesses: DataFrame, out: str, lateness: str = LATENESS) -> StreamingQuery:
    """Accesses, hits and misses per minute: a minute is appended once, when the watermark has closed it.

    Until then it is in the state, where `minute_counts_now` finds it. Rows
    that come later are dropped.
    """
    timed = accesses.withColumn("at", F.timestamp_micros(access.micros_of(F.col("ts")))).withWatermark("at", lateness)
    counts = timed.groupBy(F.window("at", "1 minute"), "cache_type", "hit").agg(F.count("*").alias("kept"))
    return (
        counts.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def minute_counts_now(spark: SparkSession, out: str) -> DataFrame:
    """Closed minutes from the files and open ones from the state; no minute is in both."""
    open_ = _state(spark, out)
    closed = spark.read.schema(open_.schema).parquet(f"{out}/data")
    minutes = F.floor(F.unix_micros(F.col("window.start")) / 60_000_000).cast("int")
    start = F.timestamp_add("MINUTE", minutes, F.lit("1970-01-01").cast("timestamp_ntz"))
    return closed.unionByName(open_).groupBy(start.alias("minute"), "cache_type").agg(
        F.sum("kept").alias("accesses"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("kept"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.col("kept"))), F.lit(0)).alias("misses"),
    )
