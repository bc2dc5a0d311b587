"""Line, name and chunk functions against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions import paths, text
from codeloom.operators import files as file_ops

ODD = ["", "\n", "a", "a\n", "\n\n", " \t\n\x1c\n", "é\u2028b\r\nc\rd", "x" * 30 + "\n" + "🙂🙂\n \xa0 \n",
       "# c\n  # d\ncode # e\n", "\x85\x0b\x0c\x1d"]


def lengths(content):
    lines = content.split("\n")
    blank = sum(not line.strip() for line in lines)
    return (len(lines), blank, len(lines) - blank, max(map(len, lines)), sum(map(len, lines)) / len(lines))


def measured(files, contents):
    df = file_ops.line_metrics(files({f"{i}.txt": c for i, c in enumerate(contents)}))
    rows = {int(r.path[:-4]): (r.total_lines, r.blank_lines, r.code_lines, r.max_line_length, r.avg_line_length)
            for r in df.collect()}
    return [rows[i] for i in range(len(contents))]


def test_line_metrics(files):
    assert measured(files, ODD) == [lengths(c) for c in ODD]


@hyp(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=20, max_size=60))
def test_line_metrics_any_text(files, contents):
    assert measured(files, contents) == [lengths(c) for c in contents]


def test_split_lines(files):
    df = file_ops.script_line_counts(files({f"{i}.py": c for i, c in enumerate(ODD)}))
    got = {int(r.path[:-3]): (r.total_lines, r.blank_lines, r.code_lines) for r in df.collect()}
    for i, content in enumerate(ODD):
        lines = [line.strip() for line in content.splitlines()]
        code = sum(bool(line) and not line.startswith("#") for line in lines)
        assert got[i] == (len(lines), sum(not line for line in lines), code), repr(content)


def one(spark, column, content):
    return spark.createDataFrame([(content,)], "content string").select(column(F.col("content"))).first()[0]


CODE = """
def ação(x): if_ = 1
function go () { return a&&b || c; }
run: function (x) {}
set = function(y) { switch (x) { case 1: do { } while (a||b) } }
arrow = (p, q) => p
public int size (int a) { if (a) else finally }
private void stop() {}
protected static Thing make() {}
char *name(int);  go (1)
class A { } class  Bé{ interface I enum E struct S_1 class A
édo for9 elif
"""


def test_names_and_keywords(spark):
    functions, classes = [], []
    for pattern, group in settings.FUNCTION_PATTERNS:
        for match in re.finditer(pattern, CODE):
            if match.group(group) not in functions:
                functions.append(match.group(group))
    for pattern in settings.CLASS_PATTERNS:
        for match in re.finditer(pattern, CODE):
            if match.group(1) not in classes:
                classes.append(match.group(1))
    branches = 1 + sum(len(re.findall(p, CODE)) for p in settings.BRANCH_PATTERNS)
    assert one(spark, text.function_names, CODE) == functions
    assert one(spark, text.class_names, CODE) == classes
    assert one(spark, text.keyword_complexity, CODE) == branches


def packed(content, limit):
    done, held = [], []
    for line in content.split("\n"):
        if sum(map(len, held)) + len(line) > limit:
            done.append("\n".join(held))
            held = []
        held.append(line)
    return [*done, "\n".join(held)]


@pytest.mark.parametrize("content", ["", "a", "abcdefgh", "ab\ncd\nef\n", "\n\nabc\n\nabcdef\n", "abcdefgh\nab"])
def test_chunks(spark, content):
    assert one(spark, lambda c: text.chunks_of(c, 4), content) == packed(content, 4)


def test_one_decimal_rounds_like_ieee(spark):
    values = [0.0, 0.05, 0.25, 0.35, 0.45, 0.75, 1.25, 2.5, 9.95, 9.96, 99.95, 1234.05, 7.0 / 3, 1e6 + 0.15]
    values += [k / 20 for k in range(400)] + [k / 7 for k in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", text.one_decimal(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in got] == [(v, f"{v:.1f}") for v in values]


def test_extensions_languages_roles(spark):
    import os
    names = ["a.py", "x/.env", "x/a.tar.GZ", "noext", "x.y/z", "a.", "..b.c", "x/..py", "d/A.Md"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r[0] for r in df.select(paths.extension(F.col("path"))).collect()]
    assert got == [os.path.splitext(n)[1].lower() for n in names]
    roles = df.sparkSession.createDataFrame(
        [("tests/test_main.py",), ("docs/README.md",), (".env",), ("src/a.py",), ("x/package.json",)], "path string")
    assert [r[0] for r in roles.select(paths.roles(F.col("path"))).collect()] == [
        ["tests"], ["docs"], ["config"], [], ["build"]]


def test_ignored(spark):
    names = ["a.min.js", "x/b.min.js", "vendor/q/z.py", "vendored/z.py", "__pycache__/cache.pyc", ".git/HEAD",
             "venv/lib/a.py", "node_modules/express/index.js", "src/main.py"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r[0] for r in df.select(paths.is_ignored(F.col("path"))).collect()]
    assert got == [True, True, True, False, True, True, True, True, False]
