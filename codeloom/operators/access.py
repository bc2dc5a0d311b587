"""Access-log analysis: oldest keys, byte budgets, reuse, rates, heat."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.operators.ordering import dense_ranked, ranked
from codeloom.session import cut_lineage

MICROS = 1_000_000


def last_access(accesses: DataFrame) -> DataFrame:
    """Newest access of each key, and the size the key had then."""
    when = F.struct("ts", "event_id")
    return accesses.groupBy("key").agg(F.max("ts").alias("last_ts"), F.max_by("size", when).alias("size"))


def evict_oldest(accesses: DataFrame, max_memory: int) -> DataFrame:
    """The oldest tenth of the keys, at least one, once memory reaches the limit."""
    order = [F.col("last_ts").asc(), F.col("key").asc()]
    keys = ranked(last_access(accesses), order, amount="size")
    tenth = F.floor(F.lit(1.0 / settings.EVICT_FRACTION_DIVISOR) * F.col("total_rows"))
    return keys.filter(
        (F.col("total_amount") >= max_memory) & (F.col("rn") <= F.greatest(F.lit(1), tenth))
    ).select("key", "last_ts", "size", "rn")


def previous_of_key(puts: DataFrame) -> DataFrame:
    """Add `prev_at` and `prev_size`, those of the put of the same key before; `at` is unique.

    Puts are cut into ranges of like size by key and place, so that a busy key is
    spread over several; the first put of a key in a range looks at the key's last
    one in the ranges before.
    """
    ranged = cut_lineage(puts.repartitionByRange("key", "at").withColumn("range_id", F.spark_partition_id()), "put_ranges")
    inside = Window.partitionBy("range_id", "key").orderBy("at")
    newest = ranged.groupBy("key", "range_id").agg(F.min("at").alias("at"), F.max_by(F.struct("at", "size"), "at").alias("last"))
    before = F.lag("last").over(Window.partitionBy("key").orderBy("at"))
    links = newest.select("key", "range_id", before.alias("linked"))
    own = F.struct("at", "size")
    return (ranged.withColumn("own", F.lag(own).over(inside)).join(links, ["key", "range_id"])
            .withColumn("prev", F.coalesce("own", "linked"))
            .select("key", "at", "size", F.col("prev.at").alias("prev_at"), F.col("prev.size").alias("prev_size")))


SLICE = 1 << 16  # puts gone through at once
CANDIDATES = 31  # places tried in one pass


def _slices(steps: DataFrame) -> DataFrame:
    """One row per slice of SLICE consecutive places: slice, and lists of its puts in order."""
    put = F.struct("at", "size", F.coalesce("prev_at", F.lit(0)).alias("prev_at"),
                   F.coalesce("prev_size", F.lit(0)).alias("prev_size"))
    sliced = steps.groupBy(F.floor(F.col("at") / SLICE).alias("slice")).agg(F.array_sort(F.collect_list(put)).alias("p"))
    return sliced.select("slice", *[F.col(f"p.{c}").alias(c) for c in ("at", "size", "prev_at", "prev_size")])


def _crowded(slices: DataFrame, places: list[int], budget: int) -> list[bool]:
    """For each of `places` whether the keys put from there on ever need more than the budget.

    What a put adds is its size less that of the key's put before, if that one is
    not older than the place. A slice sends its sum and its highest running sum for
    each place; both are combined over the slices in order.
    """
    tried = list(places)

    def measure(batches):
        at_place = np.array(tried, dtype=np.int64)
        for batch in batches:
            for number, *lists in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "size", "prev_at", "prev_size"))):
                at, size, prev_at, prev_size = (np.array(x, dtype=np.int64) for x in lists)
                sums, peaks = [], []
                for place in at_place:
                    grown = np.where(at >= place, size - np.where(prev_at >= place, prev_size, 0), 0)
                    upto = np.cumsum(grown)
                    later = upto[at > place]  # a put makes room before it comes in, but never drops itself
                    sums.append(int(upto[-1]))
                    peaks.append(int(later.max()) if len(later) else None)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([number] * len(tried), pa.int64()), "n": pa.array(range(len(tried)), pa.int32()),
                    "total": pa.array(sums, pa.int64()), "peak": pa.array(peaks, pa.int64())})

    parts = slices.filter(F.col("slice") >= min(tried) // SLICE).mapInArrow(measure, "slice long, n int, total long, peak long")
    before = Window.partitionBy("n").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    highest = parts.withColumn("high", F.coalesce(F.sum("total").over(before), F.lit(0)) + F.col("peak"))
    found = {r["n"]: r["high"] for r in highest.groupBy("n").agg(F.max("high").alias("high")).collect()}
    return [(found.get(n) or 0) > budget for n in range(len(tried))]


def evicted_upto(puts: DataFrame, n: int, budget: int) -> int:
    """The last place whose put, and with it all older ones, a cache of `budget` bytes has dropped at the end; 0 if none.

    `puts` (key, at, size) has places 1 to `n`. A least-recently-used cache holds
    the keys put after some place, and that place only moves on. It has passed a
    place if the keys put from there on needed more than the budget at any later
    put; this holds for all places up to the one looked for, which is narrowed down
    by trying many places a pass.
    """
    slices = cut_lineage(_slices(previous_of_key(puts)), "put_slices")
    low, high = 0, n  # passed, not passed
    while high - low > 1:
        step = -(-(high - low) // (CANDIDATES + 1))
        places = list(range(low + step, high, step))
        passed = sum(_crowded(slices, places, budget))
        low, high = (places[passed - 1] if passed else low), (places[passed] if passed < len(places) else high)
    return low


def recency_budget(accesses: DataFrame, budget: int) -> DataFrame:
    """Keys a least-recently-used cache of `budget` bytes holds after all accesses, each of which puts its key anew.

    A put drops the key's old value, then the oldest keys until the new one fits,
    then comes in, also if it alone is too large. Accesses come in order of time,
    then event. `running` are the bytes of a key and all fresher ones.
    """
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    puts = cut_lineage(ranked(accesses.select("event_id", "key", "ts", "size"), order), "puts")
    n = puts.count()
    dropped = evicted_upto(puts.select("key", F.col("rn").alias("at"), "size"), n, budget) if n else 0
    last = puts.groupBy("key").agg(F.max("rn").alias("at"), F.max_by(F.struct("ts", "size"), "rn").alias("w"))
    kept = last.filter(F.col("at") > dropped).select("key", F.col("w.ts").alias("last_ts"), F.col("w.size").alias("size"), "at")
    return ranked(kept, [F.col("at").desc()], amount="size").select("key", "last_ts", "size", "running")


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone; the session's zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _exits(times: Column, ttl: int) -> Column:
    """What a run of sorted times makes of the computing access before it.

    Entry i says: if the life of the result before ends ahead of `bound`, the
    last computing access of the run is `leave`. The first entry that holds
    counts; if none does, the run computes nothing. Only the accesses up to one
    TTL after the first can come first, and entries with one outcome are merged.
    """
    # Nested, so that it is shipped by value and executors need no copy of us.
    @F.pandas_udf("array<struct<bound:bigint,leave:bigint>>")
    def exits(runs: pd.Series) -> pd.Series:
        def of_run(run):
            run = np.asarray(run, dtype=np.int64)
            following = np.searchsorted(run, run + ttl, side="right").tolist()
            last = list(range(len(run)))
            for i in range(len(run) - 1, -1, -1):
                if following[i] < len(run):
                    last[i] = last[following[i]]
            found = []
            for i in range(min(following[0], len(run) - 1) + 1):
                entry = {"bound": int(run[i]), "leave": int(run[last[i]])}
                if found and found[-1]["leave"] == entry["leave"]:
                    found[-1] = entry
                else:
                    found.append(entry)
            return found

        return runs.map(of_run)

    return exits(times)


def _points(times: Column, last: Column, ttl: int) -> Column:
    """Computing accesses of a run of sorted times, going on from `last`."""
    @F.pandas_udf("array<bigint>")
    def points(runs: pd.Series, lasts: pd.Series) -> pd.Series:
        def of_run(run, last):
            run = np.asarray(run, dtype=np.int64)
            at = 0 if pd.isna(last) else int(np.searchsorted(run, int(last) + ttl, side="right"))
            found = []
            while at < len(run):
                found.append(int(run[at]))
                at = int(np.searchsorted(run, run[at] + ttl, side="right"))
            return found

        return pd.Series([of_run(run, last) for run, last in zip(runs, lasts)], dtype=object)

    return points(times, last)


def compute_points(accesses: DataFrame, ttl_seconds: int = settings.RESULT_TTL_SECONDS,
                   state: DataFrame | None = None) -> DataFrame:
    """Accesses that have to compute: key and time in microseconds.

    The first access of a key computes and its result lives for the TTL; an
    access inside that span reuses it and does not extend it. `state` (key,
    last) carries the last computing access of earlier data.

    Accesses are cut into ranges of like size by key and time, so a busy key is
    spread over several. Each range first says what it makes of any state
    before it, which is a short list as chains of different beginnings soon
    meet; per key these lists are gone through in order, and then every range
    knows its state and gives its points.
    """
    ttl = int(ttl_seconds * MICROS)
    timed = accesses.select("key", micros_of(F.col("ts")).alias("t"))
    ranged = timed.repartitionByRange("key", "t").withColumn("range_id", F.spark_partition_id())
    # The least time orders the runs of a key however the ranges are numbered.
    runs = cut_lineage(ranged.groupBy("key", "range_id").agg(
        F.sort_array(F.collect_set("t")).alias("times"), F.min("t").alias("begin")), "runs")
    steps = runs.select("key", "begin", _exits(F.col("times"), ttl).alias("exits"))
    chains = steps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "exits"))).alias("steps"))
    if state is None:
        chains = chains.withColumn("last", F.lit(None).cast("long"))
    else:
        chains = chains.join(state.select("key", F.col("last").cast("long").alias("last")), "key", "left")

    def step(seen: Column, run: Column) -> Column:
        last = F.element_at(seen, -1)
        fits = F.filter(run["exits"], lambda e: last.isNull() | (last + ttl < e["bound"]))
        return F.array_append(seen, F.coalesce(F.get(fits, F.lit(0))["leave"], last))

    lasts = F.aggregate("steps", F.array("last"), step)
    known = chains.select("key", F.explode(F.arrays_zip(
        F.col("steps.begin").alias("begin"), F.slice(lasts, F.lit(1), F.size("steps")).alias("last"))).alias("s"))
    found = runs.join(known.select("key", "s.begin", "s.last"), ["key", "begin"])
    return found.select("key", F.explode(_points(F.col("times"), F.col("last"), ttl)).alias("t"))


def ttl_reuse(accesses: DataFrame, ttl_seconds: int = settings.RESULT_TTL_SECONDS) -> DataFrame:
    """Computed and reused accesses per key."""
    points = compute_points(accesses, ttl_seconds)
    computed = points.groupBy("key").agg(F.count("*").alias("computed"))
    total = accesses.groupBy("key").agg(F.count("*").alias("n"))
    return total.join(computed, "key").select(
        "key", "computed", (F.col("n") - F.col("computed")).alias("reused")
    )


def rate_limited(runs: DataFrame, key: str, limit: int = settings.RUNS_PER_MINUTE,
                 per: str = "minute", tie: str = "event_id") -> DataFrame:
    """The first `limit` runs of each key in each fixed window of time.

    Spark keeps only the first `limit` rows per group before the shuffle, so a
    busy key costs `limit` rows per input partition.
    """
    slot = F.date_trunc(per, F.col("ts"))
    order = Window.partitionBy(key, "slot").orderBy("ts", tie)
    return runs.withColumn("slot", slot).withColumn("rn", F.row_number().over(order)).filter(
        F.col("rn") <= limit
    )


def paced(runs: DataFrame, key: str, limit: int, per_seconds: int = 60, burst: int = 1, tie: str = "event_id") -> DataFrame:
    """When each run of a key may start if starts come at a rate of `limit` per `per_seconds`: key, tie, t, start.

    Runs wait, in order of time, then `tie`; none is refused. Up to `burst` of them
    may start at once after a pause. Times are whole microseconds, a start is rounded
    up. In units of 1 / `limit` microseconds, the k-th run of a key is scheduled at
    the highest of its own time and, for every run j before it, that one's time plus
    k - j periods: a running maximum of time less periods. Maxima and counts of the
    ranges of a key are combined over its ranges, so a busy key is spread over several.
    """
    period = per_seconds * MICROS
    if limit < 1 or burst < 1 or limit > 5000:
        raise ValueError("a rate of 1 to 5000 and a burst of at least 1")
    timed = runs.select(key, tie, micros_of(F.col("ts")).alias("t"))
    ranged = cut_lineage(timed.repartitionByRange(key, "t", tie).withColumn("range_id", F.spark_partition_id()), "paced")
    inside = Window.partitionBy("range_id", key).orderBy("t", tie)
    local = ranged.withColumn("rn", F.row_number().over(inside).cast("long")).withColumn(
        "ahead", F.col("t") * limit - F.col("rn") * period)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumn("most", F.max("ahead").over(upto))
    before = Window.partitionBy(key).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(key, "range_id").agg(F.count("*").alias("n"), F.max("ahead").alias("most_here"))
    sums = sums.withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.withColumn("most_before", F.max(F.col("most_here") - F.col("rows_before") * period).over(before)).select(
        key, "range_id", "rows_before", "most_before")
    place = (F.col("rn") + F.col("rows_before")) * period
    highest = F.greatest(F.col("most") - F.col("rows_before") * period, F.col("most_before"))
    due = F.greatest(F.col("t") * limit, place + highest - (burst - 1) * period)
    return local.join(sums, [key, "range_id"]).withColumn("due", due).select(
        key, tie, "t", F.expr(f"(due + {limit - 1}) div {limit}").alias("start"))


def key_heat(accesses: DataFrame, bucket_days: int = 1) -> DataFrame:
    """Rank of keys by the accesses a linear trend forecasts for the next bucket.

    All sums are whole numbers and the forecast is one division, so it does
    not depend on the order in which partitions are merged.
    """
    bucket = F.floor(micros_of(F.col("ts")) / (MICROS * 86_400 * bucket_days)).alias("x")
    counts = cut_lineage(accesses.groupBy("key", bucket).agg(F.count("*").alias("y")), "buckets")
    # Buckets are counted back from the forecast one, so that it has number 0.
    x, y = F.col("x") - counts.agg(F.max("x") + 1).scalar(), F.col("y")
    counts = counts.withColumn("x", x)
    x = F.col("x")
    sums = counts.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
    )
    n, sx, sy, sxx, sxy = (F.col(c).cast("decimal(19,0)") for c in ("n", "sx", "sy", "sxx", "sxy"))
    spread = n * sxx - sx * sx
    slope = n * sxy - sx * sy
    trend = (sy * spread - slope * sx).cast("double") / (n * spread).cast("double")
    heat = F.when(spread == 0, F.col("sy") / F.col("n")).otherwise(trend)
    forecast = sums.select("key", F.col("n").alias("buckets"), F.col("sy").alias("accesses"), heat.alias("heat"))
    return dense_ranked(forecast, "heat", "key", "heat_rank").select(
        "key", "buckets", "accesses", "heat", "heat_rank"
    )


def popular_keys(accesses: DataFrame, k: int) -> DataFrame:
    """The k most accessed keys; a report of fixed length."""
    counted = accesses.groupBy("key").agg(F.count("*").alias("accesses"))
    return counted.orderBy(F.col("accesses").desc(), "key").limit(k)


def key_summaries(accesses: DataFrame, counters: int) -> DataFrame:
    """Of each part of the log, counts of at most `counters` keys: key, n, and one row of a null key with the slack.

    A key was accessed in the part n times at least and n + slack times at most, with
    n = 0 for keys that are not listed; the slack is below rows / counters. Null
    keys are left out.
    """
    def summed(batches):
        held, slack = pd.Series(dtype="int64"), 0
        for batch in batches:
            held = held.add(batch["key"].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters:
                # What is taken from one key is taken from `counters` others as well.
                cut = int(held.nlargest(counters + 1).iloc[-1])
                held, slack = held[held > cut] - cut, slack + cut
        yield pd.DataFrame({"key": [*held.index, None], "n": [*held, slack]})

    known = accesses.select("key").filter(F.col("key").isNotNull())
    return known.mapInPandas(summed, "key string, n long")


def popular_keys_bounded(accesses: DataFrame, k: int, counters: int = 10_000) -> DataFrame:
    """As `popular_keys`, counting only keys that can be among the first k.

    Summaries of all parts bound each key's count from both sides. Keys whose upper
    bound is below the k-th largest lower bound are out; the others are counted, in
    a second pass. Where no such line can be drawn, as keys are accessed about
    equally often, all are counted. Pays where distinct keys are many and skewed:
    `counters` keys a part are shuffled in place of all of them.
    """
    stored = cut_lineage(key_summaries(accesses, counters), "summaries")
    least = cut_lineage(stored.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("n").alias("least")), "least")
    slack = stored.filter(F.col("key").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = [row.least for row in least.orderBy(F.col("least").desc()).limit(k).collect()]
    line = first[-1] if len(first) == k and k else 0
    if slack and slack >= line:
        return popular_keys(accesses, k)
    able = least.filter(F.col("least") + slack >= line).select(F.col("key").alias("_key"))
    asked = accesses.select("key")
    counted = asked.join(able, F.col("key") == F.col("_key"), "left_semi").union(asked.filter(F.col("key").isNull()))
    return popular_keys(counted, k)
