"""Joins, cohorts and task metrics on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions import keys
from codeloom.operators import matching, metrics
from codeloom.settings import Cohort


def test_fanout(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "event_id long, type string")
    subs = [{"url": "u1", "event_types": ["a", "b", "a"]}, {"url": "u2", "event_types": ["a"]},
            {"url": "u3", "event_types": []}]
    expected = [(1, "u1"), (1, "u2"), (2, "u1"), (4, "u1"), (4, "u2")]
    assert sorted((r.event_id, r.url) for r in matching.event_fanout(events, subs).collect()) == expected
    many = [{"url": f"u{i}", "event_types": ["a"]} for i in range(2000)]
    assert matching.event_fanout(events, many).count() == 4000
    assert matching.event_fanout(events, []).count() == 0


def test_cohorts(spark):
    users = spark.range(1000).withColumnRenamed("id", "user_id")

    def shares(*cohorts):
        rows = matching.cohort_shares(matching.cohort_assignment(users, list(cohorts))).collect()
        return {r.cohort: r.users for r in rows}

    assert shares(Cohort("A", 0.0), Cohort("B", 1.0)) == {"B": 1000}
    uneven = shares(Cohort("A", 0.1), Cohort("B", 0.9))
    assert uneven["A"] + uneven["B"] == 1000 and 60 < uneven["A"] < 140
    assert shares(Cohort("control", 1.0), Cohort("B", 0.5)) == {None: 1000}
    first = matching.cohort_assignment(users, [Cohort("A", 0.5), Cohort("B", 0.5)]).collect()
    assert first == matching.cohort_assignment(users, [Cohort("A", 0.5), Cohort("B", 0.5)]).collect()


def test_cohort_document():
    made = settings.cohorts_from_mapping({"name": "t", "cohorts": {
        "A": {"description": "d", "weight": 0.5, "params": {"k": 1}}, "B": {"description": "", "weight": 1, "params": {}}}})
    assert [c.name for c in made] == ["A", "B"] and made[0].params == {"k": 1}
    with pytest.raises(ValueError):
        Cohort("A", 1.5)


def test_config():
    assert settings.config_from_json(None) == settings.EngineConfig()
    given = settings.config_from_json('{"max_complexity": 3, "language_extensions": {".x": "X"}, "timeout": 1}')
    assert given.thresholds.max_complexity == 3 and given.thresholds.max_method_lines == 30
    assert given.languages == {".x": "X"} and given.ignore_patterns == ("*.min.js", "vendor/*")


def test_keys(spark):
    df = spark.createDataFrame([("a/b", "p"), ("", "p"), ("a/b", ""), ("é", "x:y")], "path string, project string")
    rows = df.select(keys.result_key(F.col("path"), F.col("project")).alias("k")).withColumn(
        "p", keys.key_project(F.col("k"))).withColumn("v", keys.key_version(F.col("k"))).collect()
    import hashlib
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [r.k for r in rows] == [f"analysis_v2:p:{digest('a/b')}", "analysis_v2:p:",
                                   f"analysis_v2:{digest('a/b')}", f"analysis_v2:x:y:{digest('é')}"]
    assert [r.p for r in rows] == ["p", "p", "", "x:y"] and {r.v for r in rows} == {2}
    left = matching.invalidate_projects(df.select(keys.result_key(F.col("path"), F.col("project")).alias("key")), ["p"])
    assert left.count() == 2
    nulls = spark.createDataFrame([(None,)], "key string")
    for dropped in (["p"], [f"x{i}" for i in range(2000)], []):
        assert matching.invalidate_projects(nulls, dropped).count() == 1
    assert df.select(keys.key_version(F.col("path"))).first()[0] is None


def test_sizes(spark):
    df = spark.createDataFrame([(999_999,), (1_000_000,), (5_000_000,), (5_000_001,)], "s long")
    got = df.select(keys.ttl_seconds(F.col("s")), keys.needs_partitioning(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(3600, False), (600, False), (600, False), (600, True)]


def test_deadlines(spark):
    df = spark.createDataFrame([(240.0,), (240.5,), (300.0,), (300.1,)], "s double")
    assert [r[0] for r in df.select(keys.deadline_class(F.col("s"))).collect()] == ["ok", "soft", "soft", "hard"]


def test_histogram(spark):
    df = spark.createDataFrame([("a", 30.0), ("a", 30.1), ("a", 300.0), ("a", 999.9)], "task_name string, seconds double")
    rows = metrics.duration_histogram(df, "task_name").collect()
    assert {r.le: r.observations for r in rows} == {"30": 1, "60": 2, "120": 2, "180": 2, "240": 2, "300": 3, "+Inf": 4}
    assert {(r.total_count, r.total_seconds) for r in rows} == {(4, 1360.0)}


def test_merge(spark):
    df = spark.createDataFrame([
        ("p", "SUCCESS", {"a": "1", "b": "2"}, None, 1), ("p", "SUCCESS", {"a": "3"}, None, 2),
        ("p", "ERROR", None, "boom", 3), ("q", "COMPLETED", {"a": "9"}, None, 4),
    ], "project string, status string, result map<string,string>, error string, ord long")
    got = sorted(tuple(r) for r in metrics.merge_results(df).collect())
    assert got == [("p", "error", "3", "boom"), ("p", "result", "a", "3"), ("p", "result", "b", "2"),
                   ("q", "result", "a", "9")]
    strict = metrics.merge_results(df, ok_statuses=("SUCCESS",))
    assert strict.filter("kind = 'error'").count() == 2


def test_attempts(spark):
    df = spark.createDataFrame([(1, 0, "error"), (1, 1, "success"), (2, 0, "error"), (2, 4, "success")],
                               "task long, attempt long, status string")
    got = sorted(tuple(r) for r in metrics.attempt_rollup(df).collect())
    assert got == [(1, "success", 1), (2, "error", 0)]


def test_reviews(spark):
    smells = spark.createDataFrame(
        [("p", "b.py", 3, "m", "s"), ("p", "a.py", 9, "m", "s"), ("p", "z.py", 1, "m", "s"), ("q", "a.py", 5, "m", "s")],
        "project string, path string, line int, message string, suggestion string")
    changed = spark.createDataFrame(
        [(7, "p", "a.py", "c1"), (7, "p", "b.py", "c2"), (8, "p", "b.py", "c3"), (8, "p", "b.py", "c3")],
        "pr long, project string, path string, commit_id string")
    comments = matching.review_comments(smells, changed)
    assert sorted((r.pr, r.path, r.line, r.side) for r in comments.collect()) == [
        (7, "a.py", 9, "RIGHT"), (7, "b.py", 3, "RIGHT"), (8, "b.py", 3, "RIGHT")]
    heads = sorted((r.pr, r.commit_id, r.comments) for r in matching.review_headers(comments).collect())
    assert heads == [(7, "c1", 2), (8, "c3", 1)]


@pytest.mark.parametrize("expected", [1, 20, 10_000])
def test_a_bit_set_of_any_size_gives_the_exact_keys(spark, expected):
    ts = F.timestamp_seconds(F.col("id"))
    asked = spark.range(500).select(F.col("id").cast("string").alias("key"), ts.alias("ts"))
    seen = spark.range(250).select(F.col("id").cast("string").alias("key"))
    exact = sorted(map(tuple, matching.new_keys(asked, seen).collect()))
    assert {k for k, *_ in exact} == {str(i) for i in range(250, 500)}
    assert sorted(map(tuple, matching.new_keys_by_bits(asked, seen, expected).collect())) == exact


def test_results_expire(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 100)], "key string, data double, at long").select(
        "key", "data", F.timestamp_seconds("at").cast("timestamp_ntz").alias("stored_at"))
    now = F.timestamp_seconds(F.lit(160)).cast("timestamp_ntz")
    assert [r.key for r in metrics.live_results(df, now, 60).collect()] == ["b"]
