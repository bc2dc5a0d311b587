"""Each stream over several micro-batches and runs equals its batch twin."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import access, matching, metrics
from codeloom.plans import catalog
from codeloom.sources import derived
from codeloom.sources.tables import table
from codeloom.streaming import streams
from conftest import DATA


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = table(spark, DATA, "events")
    for k in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == k).coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def source(spark, parts):
    return streams.folder_stream(spark, parts[0], parts[1].schema)


def test_fanout(spark, parts, tmp_path):
    out = str(tmp_path)
    stream = derived.domain_events_of(source(spark, parts))
    for _ in range(2):
        streams.event_fanout(stream, derived.SUBSCRIPTIONS, out).awaitTermination()
    batch = matching.event_fanout(derived.domain_events_of(parts[1]), derived.SUBSCRIPTIONS)
    assert rows(spark.read.parquet(f"{out}/data").select(batch.columns)) == rows(batch)


def test_last_access(spark, parts, tmp_path):
    out = str(tmp_path)
    streams.last_access(derived.accesses_of(source(spark, parts)), out).awaitTermination()
    batch = access.last_access(derived.accesses_of(parts[1])).select("key", "last_ts")
    assert rows(streams.last_access_snapshot(spark, out)) == rows(batch)


def test_compute_points(spark, parts, tmp_path):
    out = str(tmp_path)
    stream = derived.accesses_of(source(spark, parts))
    for _ in range(2):
        streams.compute_points(stream, out).awaitTermination()
    batch = rows(access.compute_points(derived.accesses_of(parts[1]), 7200))
    assert rows(streams.compute_points_snapshot(spark, out, 7200)) == batch
    streams.compact(spark, out, streams.merge_accesses)
    assert rows(streams.compute_points_snapshot(spark, out, 7200)) == batch


def test_files_out_of_order_make_no_difference(spark, parts, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (F.col("event_id") >= 500, F.col("event_id") < 500):
        parts[1].filter(part).coalesce(1).write.mode("append").parquet(folder)
        stream = derived.accesses_of(streams.folder_stream(spark, folder, parts[1].schema))
        streams.compute_points(stream, out).awaitTermination()
    batch = access.compute_points(derived.accesses_of(parts[1]), 7200)
    assert rows(streams.compute_points_snapshot(spark, out, 7200)) == rows(batch)


def timed_files(spark, folder, accesses):
    """One file for each list of (key, seconds), in the order given."""
    start = dt.datetime(2024, 1, 1)
    for some in accesses:
        rows = [(k, start + dt.timedelta(seconds=s)) for k, s in some]
        spark.createDataFrame(rows, "key string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)
    return streams.folder_stream(spark, folder, spark.read.parquet(folder).schema)


def test_ttl_points_of_ordered_files_equal_the_batch(spark, parts, tmp_path):
    out = str(tmp_path)
    stream = derived.accesses_of(source(spark, parts))
    for _ in range(2):
        streams.ttl_points(stream, out, 7200).awaitTermination()
    batch = access.compute_points(derived.accesses_of(parts[1]), 7200)
    assert rows(streams.ttl_points_written(spark, out)) == rows(batch)


def test_ttl_points_go_on_after_a_restart_with_little_state(spark, tmp_path):
    """Every file has keys of its own and one that is always there; state of keys whose result has died is dropped."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    draw = random.Random(4)
    sent, kept = [], []
    for run in range(4):
        files = [sorted([(f"k{run}-{f}-{i}", (run * 4 + f) * 1000 + draw.randrange(1000)) for i in range(30)]
                        + [("always", (run * 4 + f) * 1000 + s) for s in range(0, 1000, 90)], key=lambda r: r[1])
                 for f in range(4)]
        stream = timed_files(spark, folder, files)
        query = streams.ttl_points(stream, out, 600, lateness="1 second")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        sent += [row for rows_ in files for row in rows_]
    plain, ends = [], {}
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    for key, second in sent:
        if key not in ends or second > ends[key] + 600:
            ends[key] = second
            plain.append((key, (start + second) * 1_000_000))
    assert rows(streams.ttl_points_written(spark, out)) == sorted(plain, key=repr)
    assert max(kept) <= 2 * 31, kept  # of 481 keys


def test_reuse_on_a_stream_does_not_extend_the_life(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = timed_files(spark, folder, [[("a", 0), ("a", 50)], [("a", 100)], [("a", 101), ("a", 101)], [("a", 150), ("a", 202)]])
    streams.ttl_points(stream, out, 100).awaitTermination()
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert [r.t // 1_000_000 - start for r in streams.ttl_points_written(spark, out).orderBy("t").collect()] == [0, 101, 202]


def test_equal_times_are_settled_by_the_event(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, version int, project string, data double, ts timestamp_ntz, event_id long"
    when = dt.datetime(2024, 1, 1)
    for event in (9, 3):
        spark.createDataFrame([("a", 2, "p", float(event), when, event)], schema).write.mode("append").parquet(folder)
        stream = streams.folder_stream(spark, folder, spark.read.parquet(folder).schema)
        streams.latest_results(stream, out).awaitTermination()
        streams.compact(spark, out, streams.merge_latest)
    assert [r.data for r in streams.latest_results_snapshot(spark, out).collect()] == [9.0]


def test_minute_counts(spark, parts, tmp_path):
    out = str(tmp_path)
    streams.minute_counts(derived.accesses_of(source(spark, parts)), out).awaitTermination()
    batch = derived.accesses_of(parts[1]).groupBy(
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "cache_type"
    ).agg(F.count("*"), F.count_if("hit"), F.count_if(~F.col("hit")))
    assert rows(streams.minute_counts_snapshot(spark, out)) == rows(batch)


def test_late_rows_are_dropped(spark, parts, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = parts[1]
    newest = events.orderBy(F.col("ts").desc()).limit(5)
    oldest = events.orderBy("ts").limit(5)
    newest.coalesce(1).write.mode("append").parquet(folder)
    stream = derived.accesses_of(streams.folder_stream(spark, folder, events.schema))
    streams.minute_counts(stream, out).awaitTermination()
    oldest.coalesce(1).write.mode("append").parquet(folder)
    streams.minute_counts(stream, out).awaitTermination()
    assert streams.minute_counts_snapshot(spark, out).agg(F.sum("accesses")).first()[0] == 5


def test_latest_results(spark, parts, tmp_path):
    out = str(tmp_path)
    stream = catalog._keyed(derived.stored_results_of(source(spark, parts)))
    streams.latest_results(stream, out).awaitTermination()
    batch = metrics.latest_results(catalog._keyed(derived.stored_results_of(parts[1])))
    assert rows(streams.latest_results_snapshot(spark, out)) == rows(batch)


def test_popular_refresh(spark, parts, tmp_path):
    out = str(tmp_path)
    streams.access_counts(derived.accesses_of(source(spark, parts)), out).awaitTermination()
    want = rows(access.popular_keys(derived.accesses_of(parts[1]), 5))
    assert rows(streams.popular_snapshot(spark, out, 5)) == want
    streams.compact(spark, out, streams.merge_counts)
    assert rows(streams.popular_snapshot(spark, out, 5)) == want


def result_files(spark, folder, files, schema="key string, version int, project string, data double, ts timestamp_ntz, event_id long"):
    start = dt.datetime(2024, 1, 1)
    for some in files:
        made = [(k, v, "p", float(e), None if s is None else start + dt.timedelta(seconds=s), e) for k, v, s, e in some]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.folder_stream(spark, folder, spark.read.parquet(folder).schema)


def test_live_results_of_state_equal_the_batch_in_any_order(spark, parts, tmp_path):
    ttl = catalog.LIVE_SECONDS
    events, folder, out = parts[1], str(tmp_path / "in"), str(tmp_path / "out")
    want_from = catalog._keyed(derived.stored_results_of(events))
    now = want_from.agg(F.max("ts")).first()[0]
    for part in (F.col("event_id") >= 600, F.col("event_id") < 300, F.col("event_id").between(300, 599)):
        events.filter(part).coalesce(1).write.mode("append").parquet(folder)
        stream = catalog._keyed(derived.stored_results_of(streams.folder_stream(spark, folder, events.schema)))
        streams.live_results_kept(stored=stream, out=out, ttl_seconds=ttl).awaitTermination()
    ends = F.lit(now).cast("timestamp_ntz")
    batch = rows(metrics.live_results(metrics.latest_results(want_from), ends, ttl))
    assert batch and rows(streams.live_results_of_state(spark, out, ends, ttl)) == batch


@pytest.fixture
def two_state_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_of_live_results_is_bounded_over_many_batches(spark, tmp_path, two_state_parts):
    """Fifty micro-batches, four starts: state holds the keys of about two lives, not those of all batches."""
    folder, out, draw, sent, kept, number = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(8), [], [], 0
    for size in (20, 10, 10, 10):
        files = []
        for _ in range(size):
            files.append([(f"k{number}-{i}", 2, number * 100 + draw.randrange(100), number * 10 + i) for i in range(6)]
                         + [("often", 2, number * 100 + draw.randrange(100), number * 10 + 7),
                            ("old", 1, number * 100, number * 10 + 8), ("timeless", 2, None, number * 10 + 9)])
            number += 1
        query = streams.live_results_kept(result_files(spark, folder, files), out, 2, 300, "1 second")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        sent += [row for rows_ in files for row in rows_]
    newest = max(s for _, v, s, _ in sent if s is not None)
    start, last = dt.datetime(2024, 1, 1), {}
    for key, version, second, event in sent:
        if version == 2 and second is not None:
            last[key] = max(last.get(key, (-1, -1)), (second, event))
    plain = [(k, float(e), start + dt.timedelta(seconds=s), e) for k, (s, e) in last.items() if s + 300 >= newest]
    now = F.lit(start + dt.timedelta(seconds=newest)).cast("timestamp_ntz")
    assert rows(streams.live_results_of_state(spark, out, now, 300)) == sorted(plain, key=repr)
    assert max(kept) <= 7 * 4 * 3, kept  # of 301 keys


def test_equal_times_and_repeated_rows_in_state(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = [[("a", 2, 0, 9), ("a", 2, 0, 9), (None, 2, 0, 1)], [("a", 2, 0, 3)]]
    for some in files:
        streams.live_results_kept(result_files(spark, folder, [some]), out, 2, 60).awaitTermination()
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    assert {(r.key, r.data) for r in streams.live_results_of_state(spark, out, now, 60).collect()} == {("a", 9.0), (None, 1.0)}


def test_popular_of_state(spark, parts, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        streams.counts_kept(derived.accesses_of(source(spark, parts)), out).awaitTermination()
    assert rows(streams.popular_of_state(spark, out, 5)) == rows(access.popular_keys(derived.accesses_of(parts[1]), 5))


def test_closed_minutes_are_written_once(spark, parts, tmp_path):
    out = str(tmp_path)
    streams.minute_counts_closed(derived.accesses_of(source(spark, parts)), out).awaitTermination()
    batch = derived.accesses_of(parts[1]).groupBy(
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "cache_type"
    ).agg(F.count("*"), F.count_if("hit"), F.count_if(~F.col("hit")))
    assert rows(streams.minute_counts_now(spark, out)) == rows(batch)
    closed, open_ = spark.read.parquet(f"{out}/data"), streams._state(spark, out)
    names = ["window", "cache_type", "hit"]
    assert closed.count() == closed.select(names).distinct().count() > 0
    assert closed.join(open_, names).count() == 0
    assert open_.count() < closed.count()
