"""Places where two collections meet.

No side is broadcast by hint. Spark broadcasts a side it knows to be below
its size threshold and otherwise shuffles both, splitting skewed partitions.
Small configuration (cohorts, subscriptions) comes as Python lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions import keys
from codeloom.session import cut_lineage

SALTS = 64


def event_fanout(events: DataFrame, subscriptions: list[dict]) -> DataFrame:
    """One row per event and subscription that lists its type.

    Event types are few, so a join on the type alone could not be spread over
    many tasks: events carry a salt, and each listed type has a copy for every
    salt. Spark sends the list to all executors as long as it is short.
    """
    pairs = sorted({(t, s["url"]) for s in subscriptions for t in s["event_types"]})
    listed = events.sparkSession.createDataFrame(pairs, "type string, url string").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    salted = events.withColumn("salt", F.pmod(F.xxhash64(*events.columns), F.lit(SALTS)).cast("int"))
    joined = salted.join(listed, ["type", "salt"])
    return joined.select(*events.columns, "url")


def new_keys(requested: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys not seen before, with the first request; repeats are merged first."""
    first = requested.groupBy("key").agg(F.min("ts").alias("first_ts"), F.count("*").alias("requests"))
    # The optimizer would move the anti join below the aggregate, where a busy
    # key still has all its rows; the partition number holds it above.
    held = first.withColumn("at", F.spark_partition_id())
    left = held.join(seen.select("key").distinct(), "key", "left_anti")
    return left.filter(F.col("at") >= 0).drop("at")


def new_keys_by_bits(requested: DataFrame, seen: DataFrame, expected: int = 1 << 24) -> DataFrame:
    """The same as `new_keys`, with a bit set that spares most keys the join with `seen`.

    The set has 16 bits per `expected` seen key, kept as 64-bit words. A free
    bit proves a key new; a taken one proves nothing, and those keys are looked
    up in `seen` itself. More seen keys than expected cost time, not results.
    """
    bits = 16 * expected

    def place(key):
        return F.pmod(F.xxhash64(key), F.lit(bits))

    words = seen.select(place(F.col("key")).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("mask")
    )
    asked = requested.groupBy("key").agg(F.min("ts").alias("first_ts"), F.count("*").alias("requests"))
    placed = asked.withColumn("p", place(F.col("key"))).withColumn("word", F.floor(F.col("p") / 64))
    bit = F.call_function("shiftright", F.coalesce("mask", F.lit(0).cast("long")), (F.col("p") % 64).cast("int"))
    marked = cut_lineage(placed.join(words, "word", "left").select(
        "key", "first_ts", "requests", (bit.bitwiseAND(F.lit(1).cast("long")) == 1).alias("taken")), "marked")
    free = marked.filter(~F.col("taken")).drop("taken")
    unsure = marked.filter("taken").drop("taken")
    return free.unionByName(unsure.join(seen.select("key").distinct(), "key", "left_anti"))


def cohort_assignment(users: DataFrame, cohorts: list[settings.Cohort], user: str = "user_id") -> DataFrame:
    """The first cohort whose cumulative weight reaches the user's point.

    The point is drawn from a hash of the user, so a user keeps the cohort. A
    `control` cohort of full weight switches routing off: no cohort then.
    """
    if any(c.name == "control" and c.weight >= 1.0 for c in cohorts):
        return users.withColumn("cohort", F.lit(None).cast("string"))
    point = keys.unit_point(F.col(user).cast("string")) * F.lit(float(sum(c.weight for c in cohorts)))
    reached, cases = 0.0, []
    for cohort in cohorts:
        reached += cohort.weight
        cases.append(F.when(point <= F.lit(reached), F.lit(cohort.name)))
    return users.withColumn("cohort", F.coalesce(*cases))


def cohort_shares(assigned: DataFrame) -> DataFrame:
    """Observed share of each cohort; the window runs over the few cohort rows."""
    counted = assigned.groupBy("cohort").agg(F.count("*").alias("users"))
    total = F.expr("sum(users) over ()")
    return counted.select("cohort", "users", (F.col("users") / total).alias("share"))


def request_status(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Answer to each request: error for an empty or unknown path, else done."""
    empty = F.coalesce(F.col("path"), F.lit("")) == ""

    def answer(rows: DataFrame, status: str, message: Column) -> DataFrame:
        return rows.select("event_id", "path", F.lit(status).alias("status"), message.alias("message"))

    # An empty path needs no lookup, and all of them would meet in one task.
    blank = answer(requests.filter(empty), "ERROR", F.lit(settings.EMPTY_PATH_MESSAGE))
    known = projects.select("path").distinct().withColumn("known", F.lit(True))
    asked = requests.filter(~empty).join(known, "path", "left")
    found = F.col("known").isNotNull()
    return blank.unionByName(asked.select(
        "event_id", "path",
        F.when(found, F.lit("COMPLETED")).otherwise(F.lit("ERROR")).alias("status"),
        F.when(found, F.lit(settings.DONE_MESSAGE))
        .otherwise(F.concat(F.lit(settings.MISSING_PATH_MESSAGE), F.col("path"))).alias("message"),
    ))


def invalidate_projects(stored: DataFrame, projects: list[str]) -> DataFrame:
    """Keys left after all keys of the given projects are dropped; a null key stays."""
    dropped = stored.sparkSession.createDataFrame([(p,) for p in sorted(set(projects))], "dropped string")
    return stored.join(dropped, keys.key_project(F.col("key")) == F.col("dropped"), "left_anti")


def review_comments(smells: DataFrame, changed: DataFrame) -> DataFrame:
    """Smells in the files of a pull request, shaped as review comments."""
    body = F.concat_ws("\n", "message", "suggestion")
    touched = changed.select("pr", "project", "path", "commit_id").distinct()
    return smells.join(touched, ["project", "path"]).select(
        "pr", "commit_id", "project", "path", "line", F.lit("RIGHT").alias("side"), body.alias("body")
    )


def review_headers(comments: DataFrame, event: str = "COMMENT") -> DataFrame:
    """One review per pull request, at the commit of its first comment.

    The comments stay a table of their own: a review may have any number.
    """
    first = F.struct("project", "path", "line", "commit_id")
    return comments.groupBy("pr").agg(
        F.min(first)["commit_id"].alias("commit_id"),
        F.count("*").alias("comments"),
    ).select("pr", "commit_id", F.lit(settings.REVIEW_BODY).alias("body"), F.lit(event).alias("event"), "comments")
