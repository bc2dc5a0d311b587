"""Ranks, eviction, budgets, reuse and rates against plain Python."""

import datetime as dt
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from codeloom.operators import access
from codeloom.operators.ordering import dense_ranked, ranked

START = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """Rows of (key, seconds, size)."""
    data = [(i, k, START + dt.timedelta(seconds=s), size) for i, (k, s, size) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, key string, ts timestamp_ntz, size long")


def random_log(spark, n=400, keys=12, span=9000, seed=1):
    random.seed(seed)
    rows = [(f"k{int(random.random() ** 2 * keys)}", random.randint(0, span * 1000) / 1000, 0) for _ in range(n)]
    rows = sorted(rows, key=lambda r: r[1])
    return rows, log(spark, [(k, s, 10 + 7 * int(k[1:])) for k, s, _ in rows])


def test_ranked_matches_a_global_window(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(7)
    got = ranked(df, [F.col("v").desc(), F.col("id")], amount="v").collect()
    expected = sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda p: (-p[0], p[1]))
    total = sum(v for v, _ in expected)
    running, by_id = 0, {}
    for rn, (v, i) in enumerate(expected, 1):
        running += v
        by_id[i] = (rn, running, 1000, total)
    assert {r["id"]: (r["rn"], r["running"], r["total_rows"], r["total_amount"]) for r in got} == by_id


@pytest.mark.parametrize("keys,gone", [(5, 1), (20, 2), (39, 3)])
def test_evict_oldest(spark, keys, gone):
    df = log(spark, [(f"k{i:02d}", i, 10) for i in range(keys)] + [("k00", 1000, 10)])
    got = sorted(r.key for r in access.evict_oldest(df, max_memory=10).collect())
    assert got == [f"k{i:02d}" for i in range(1, gone + 1)]
    assert access.evict_oldest(df, max_memory=10 * keys + 1).count() == 0


@pytest.mark.parametrize("budget", [5, 60, 200, 10_000])
def test_recency_budget_is_what_a_cache_keeps(spark, budget):
    rows, df = random_log(spark)
    cache, used = OrderedDict(), 0
    sizes = {(k, s): 10 + 7 * int(k[1:]) for k, s, _ in rows}
    for key, second, _ in rows:
        size = sizes[key, second]
        used -= cache.pop(key, 0)
        while cache and used + size > budget:
            used -= cache.popitem(last=False)[1]
        cache[key] = size
        used += size
    assert {r.key for r in access.recency_budget(df, budget).collect()} == set(cache)


def kept_by_a_cache(puts, budget):
    """Keys of a plain cache after puts of (key, size) in order."""
    cache, used = OrderedDict(), 0
    for key, size in puts:
        used -= cache.pop(key, 0)
        while cache and used + size > budget:
            used -= cache.popitem(last=False)[1]
        cache[key] = size
        used += size
    return cache


def test_a_key_dropped_by_a_large_one_stays_away_when_that_shrinks(spark):
    df = log(spark, [("a", 1, 3), ("b", 2, 9), ("b", 3, 3)])
    assert [tuple(r)[0] for r in access.recency_budget(df, 10).collect()] == ["b"]


@pytest.mark.parametrize("seed", range(6))
def test_recency_budget_equals_a_loop_when_sizes_change(spark, seed):
    draw = random.Random(seed)
    n, keys = draw.choice([1, 2, 40, 700]), draw.choice([2, 15, 60])
    puts = [(f"k{int(draw.random() ** 2 * keys)}", draw.choice([1, 5, 20, 300]) * draw.randint(0, 9)) for _ in range(n)]
    budget = draw.choice([0, 50, 900, 4000, 10**9])
    df = log(spark, [(k, i // 3, size) for i, (k, size) in enumerate(puts)])
    with_ranges(spark, draw.choice([1, 7]))
    try:
        got = access.recency_budget(df.repartition(3), budget).collect()
    finally:
        with_ranges(spark, None)
    want = kept_by_a_cache(puts, budget)
    assert {r["key"]: r["size"] for r in got} == want
    running, upto = 0, {}
    for key in reversed(want):
        running += want[key]
        upto[key] = running
    assert {r["key"]: r["running"] for r in got} == upto


def test_recency_budget_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(access, "SLICE", 8)
    monkeypatch.setattr(access, "CANDIDATES", 3)
    draw = random.Random(9)
    puts = [(f"k{draw.randrange(40)}", draw.randrange(100)) for _ in range(300)]
    df = log(spark, [(k, i, size) for i, (k, size) in enumerate(puts)])
    assert {r["key"] for r in access.recency_budget(df, 700).collect()} == set(kept_by_a_cache(puts, 700))
    assert access.recency_budget(df.limit(0), 700).collect() == []


def computing(rows, ttl, ends=None):
    ends, out = dict(ends or {}), []
    for key, second, _ in rows:
        if key not in ends or second > ends[key] + ttl:
            ends[key] = second
            out.append((key, second))
    return out


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_compute_points(spark, ranges):
    """A loop agrees, whether a key is in one range or spread over many."""
    rows, df = random_log(spark)
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    with_ranges(spark, ranges)
    try:
        got = [(r.key, (r.t - base) / 1e6) for r in access.compute_points(df, 600).collect()]
    finally:
        with_ranges(spark, None)
    assert sorted(got) == sorted(computing(rows, 600))


@pytest.mark.parametrize("ranges", [1, 30])
def test_compute_points_go_on_from_state(spark, ranges):
    rows, df = random_log(spark)
    cut = START + dt.timedelta(seconds=4000)
    whole = sorted(map(tuple, access.compute_points(df, 600).collect()))
    first = access.compute_points(df.filter(F.col("ts") < F.lit(cut)), 600)
    state = first.groupBy("key").agg(F.max("t").alias("last"))
    with_ranges(spark, ranges)
    try:
        second = access.compute_points(df.filter(F.col("ts") >= F.lit(cut)), 600, state=state).collect()
    finally:
        with_ranges(spark, None)
    assert sorted(map(tuple, first.collect() + second)) == whole


def with_ranges(spark, number):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.shuffle.partitions": str(number)}
    for key, value in settings.items():
        if number:
            spark.conf.set(key, value)
    if not number:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_size_is_that_of_the_last_access(spark):
    df = log(spark, [("a", 1, 100), ("a", 2, 10), ("b", 3, 10)])
    assert {(r.key, r.size) for r in access.recency_budget(df, 50).collect()} == {("a", 10), ("b", 10)}


def test_times_do_not_depend_on_the_zone(spark):
    df = log(spark, [("a", 0, 1)])
    want = access.compute_points(df, 60).collect()
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert access.compute_points(df, 60).collect() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dense_ranks_over_many_ranges(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 * F.col("id") % 3).cast("double").alias("v"))
    with_ranges(spark, 20)
    try:
        got = {r.id: r.place for r in dense_ranked(df, "v", "id", "place").collect()}
    finally:
        with_ranges(spark, None)
    values = sorted({r.v for r in df.collect()}, reverse=True)
    assert got == {r.id: values.index(r.v) + 1 for r in df.collect()}


def test_reuse_does_not_extend_the_life(spark):
    df = log(spark, [("a", s, 1) for s in (0, 50, 100, 101, 150, 202, 1000)])
    assert [tuple(r) for r in access.ttl_reuse(df, 100).collect()] == [("a", 4, 3)]


def test_rate_limit(spark):
    df = log(spark, [("a", s, 1) for s in (0, 10, 59, 60, 61)] + [("b", 5, 1)])
    got = access.rate_limited(df, "key", limit=2).collect()
    assert sorted((r.key, r.event_id) for r in got) == [("a", 0), ("a", 1), ("a", 3), ("a", 4), ("b", 5)]


def test_rate_limit_is_cut_before_the_shuffle(spark):
    df = log(spark, [("a", s, 1) for s in range(3)])
    plan = access.rate_limited(df, "key", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def plain_starts(times, limit, per, burst):
    """Starts of one key's sorted times by going through them, in fractions of microseconds."""
    from fractions import Fraction
    period, ahead, found = Fraction(per * 1_000_000, limit), None, []
    for t in times:
        scheduled = t if ahead is None else max(t, ahead)
        found.append(-(-max(t, scheduled - (burst - 1) * period) // 1))
        ahead = scheduled + period
    return found


@pytest.mark.parametrize("ranges", [1, 20])
@pytest.mark.parametrize("limit,per,burst", [(100, 60, 1), (7, 60, 1), (3, 1, 5), (1, 30, 2)])
def test_paced_starts_equal_a_loop(spark, ranges, limit, per, burst):
    rows, df = random_log(spark)
    with_ranges(spark, ranges)
    try:
        got = access.paced(df, "key", limit, per, burst).collect()
    finally:
        with_ranges(spark, None)
    by_key = {}
    for r in sorted(got, key=lambda r: (r["t"], r["event_id"])):
        by_key.setdefault(r["key"], []).append((r["t"], r["start"]))
    assert sum(map(len, by_key.values())) == len(rows)
    for pairs in by_key.values():
        assert [s for _, s in pairs] == plain_starts([t for t, _ in pairs], limit, per, burst)


def test_a_rate_lets_no_burst_through_at_the_edge_of_a_minute(spark):
    df = log(spark, [("a", 59 + i / 1000, 1) for i in range(100)] + [("a", 61 + i / 1000, 1) for i in range(100)])
    starts = sorted(r["start"] for r in access.paced(df, "key", 100).collect())
    assert all(b - a >= 600_000 for a, b in zip(starts, starts[1:]))
    assert max(sum(s <= t < s + 60_000_000 for t in starts) for s in starts) == 100


def test_heat(spark):
    day = 86_400
    rows = [("up", d * day, 1) for d in range(4) for _ in range(d + 1)]
    rows += [("down", d * day, 1) for d in range(4) for _ in range(4 - d)]
    rows += [("once", 0, 1)] * 3 + [("flat", d * day, 1) for d in range(4)]
    got = {r.key: (r.heat, r.heat_rank) for r in access.key_heat(log(spark, rows)).collect()}
    assert got == {"up": (5.0, 1), "once": (3.0, 2), "flat": (1.0, 3), "down": (0.0, 4)}


def test_popular(spark):
    df = log(spark, [("b", 1, 1), ("a", 2, 1), ("c", 3, 1), ("c", 4, 1)])
    assert [tuple(r) for r in access.popular_keys(df, 2).collect()] == [("c", 2), ("a", 1)]


def keys_log(spark, keys, parts):
    return spark.createDataFrame([(k,) for k in keys], "key string").repartition(parts)


@pytest.mark.parametrize("seed", range(4))
def test_bounded_popular_keys_equal_the_full_count(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{int(rng.paretovariate(0.7))}" for _ in range(3000)] + [None] * rng.choice([0, 40])
    for counters in (1, 12, 100, 10_000):
        frame = keys_log(spark, keys, rng.randint(1, 6))
        assert access.popular_keys_bounded(frame, 5, counters).collect() == access.popular_keys(frame, 5).collect()


def test_bounded_popular_keys_without_a_line(spark):
    """Equal counts, ties at the line, fewer keys than asked for, no rows."""
    flat = keys_log(spark, [f"k{i % 50}" for i in range(500)], 3)
    tied = keys_log(spark, ["a"] * 30 + ["b"] * 20 + ["c"] * 20 + ["d"] * 20 + [f"x{i}" for i in range(40)], 3)
    for frame in (flat, tied, flat.limit(0), keys_log(spark, [None, "a"], 1)):
        for k in (1, 3, 60):
            assert access.popular_keys_bounded(frame, k, 8).collect() == access.popular_keys(frame, k).collect()


def test_summaries_bound_counts_and_stay_small(spark):
    rng = random.Random(8)
    keys = [f"k{int(rng.paretovariate(0.8))}" for _ in range(20_000)]
    frame = keys_log(spark, keys, 4)
    rows = access.key_summaries(frame, 50).collect()
    slack = sum(r.n for r in rows if r.key is None)
    least = {}
    for r in rows:
        if r.key is not None:
            least[r.key] = least.get(r.key, 0) + r.n
    true = {k: keys.count(k) for k in set(keys)}
    assert len(rows) <= 4 * 51 and slack * 51 <= len(keys)
    assert all(least.get(k, 0) <= n <= least.get(k, 0) + slack for k, n in true.items())
    # A full count shuffles every distinct key of every part.
    assert frame.select("key", F.spark_partition_id()).distinct().count() > 2 * len(rows)


def test_summaries_of_a_log_with_a_long_tail_are_a_tenth_of_its_keys(spark):
    rng = random.Random(9)
    keys = [f"k{rng.randint(1, 20)}" if rng.random() < 0.5 else f"once{i}" for i in range(20_000)]
    frame = keys_log(spark, keys, 4)
    per_part = frame.select("key", F.spark_partition_id()).distinct().count()
    assert per_part > 10 * access.key_summaries(frame, 50).count()
    assert access.popular_keys_bounded(frame, 10, 50).collect() == access.popular_keys(frame, 10).collect()
