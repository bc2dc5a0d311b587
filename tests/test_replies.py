"""Prompts, parsing of replies, lint output, dependencies."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from codeloom.plans.catalog import QUERIES
from conftest import DATA
from codeloom import settings
from codeloom.operators import files as file_ops
from codeloom.operators import replies


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, response string")


def test_suggestions(spark):
    df = table(spark, [
        "intro\nSugestão: lost\n- Linha 3: a: b \n\n  Sugestão: x = 1\n  Explicação: why: so\n- Linha 10 : c",
        "- Linha 1: m\n- Linha um: bad\nSugestão: late\n- Linha: bad\n- Linha 2: n",
        "- Linhas da classe 7: z\nSugestão:\nSugestão: twice",
        "- Linha 5 sem dois pontos\nnada", "",
    ])
    got = [tuple(r) for r in replies.parse_suggestions(df).orderBy("doc_id", "record").collect()]
    assert got == [
        (0, 0, 3, "a: b", "x = 1", "why: so"), (0, 1, 10, "c", None, None),
        (1, 0, 1, "m", "late", None), (1, 1, 2, "n", None, None),
        (2, 0, 7, "z", "twice", None),
    ]
    repeated = replies.parse_suggestions(df, repeat_on_bad_header=True)
    assert repeated.filter("doc_id = 1 AND record = 0").count() == 3
    assert repeated.count() == 7


def test_python_suggestions(spark):
    df = table(spark, [
        "Olá\nLinha 12:\nOriginal: a\nSUGESTÃO: b:c\nExplicação: d\nLine x\nLinha 1 a 3: q\noriginal: z",
        "sugestão: early\nLinha 4", "nothing here", "Linha 123456789012345678901234567890: x",
    ])
    got = [tuple(r) for r in replies.parse_python_suggestions(df).orderBy("doc_id", "record").collect()]
    assert got == [
        (0, 0, 12, "a", "b:c", "d", 0.8), (0, 1, 0, "", "", "", 0.8), (0, 2, 13, "z", "", "", 0.8),
        (1, 0, 0, "", "early", "", 0.8), (1, 1, 4, "", "", "", 0.8), (3, 0, 0, "", "", "", 0.8),
    ]


def test_prompts_and_responses(files, spark):
    df = files({"a.py": "x = 1", "b.md": "# t", "c.ino": "void setup() {}"})
    asked = replies.prompts(df, chunk_size=3).cache()
    kinds = sorted((r.path, r.kind, r.chunk_no) for r in asked.collect())
    assert kinds == [("a.py", "code", 0), ("a.py", "code", 1), ("a.py", "summary", -1), ("b.md", "summary", -1),
                     ("c.ino", "code", 0), ("c.ino", "code", 1), ("c.ino", "summary", -1)]
    row = asked.filter("path = 'a.py' AND chunk_no = 1").first()
    assert "código Python e" in row.prompt and "\n\nx = 1\n\n" in row.prompt
    assert row.prompt_hash == hashlib.sha256(row.prompt.encode()).hexdigest()
    typed = replies.prompts(df, typed=True).filter("path = 'c.ino' AND kind = 'summary'").first()
    assert typed.prompt.startswith("Analise o seguinte código Arduino")

    @F.pandas_udf("string")
    def echo(prompt: pd.Series) -> pd.Series:
        return prompt.str.len().astype(str)

    answers = replies.complete(asked.unionByName(asked).filter("kind = 'summary' AND path != 'b.md'"), echo)
    assert answers.count() == 2
    joined = {(r.path, r.kind, r.chunk_no): r.response for r in replies.attach_responses(asked, answers).collect()}
    assert joined[("a.py", "summary", -1)].isdigit()
    assert joined[("b.md", "summary", -1)] == settings.NO_SUMMARY_TEXT
    assert joined[("a.py", "code", 0)] is None


def test_lint(spark):
    raw = '[{"type":"convention","line":1,"message":"c","score":7.5},{"type":"error","line":2,"message":"e"},' \
          '{"type":"warning","line":3,"message":"w"}]'
    df = spark.createDataFrame([("p", 1, raw), ("p", 2, "[]"), ("p", 3, '[{"type":"error","line":4,"message":"m"}]')],
                               "project string, doc_id int, raw_json string")
    got = [tuple(r) for r in replies.lint_report(df).orderBy("doc_id").collect()]
    assert got == [("p", 1, 7.5, 2, "2:e;3:w"), ("p", 2, 0.0, 0, ""), ("p", 3, 0.0, 1, "4:m")]
    assert replies.lint_messages(df).count() == 3


def test_dependencies(spark):
    df = spark.createDataFrame([
        ("p", "requirements.txt", "pytest>=7.0.0\nrequests>=2.0.0"),
        ("p", "web/package.json", '{"dependencies": {"express": "^4.0.0"}}'),
        ("p", "package.json", "{}"), ("p", "other.txt", "x"),
    ], "project string, path string, content string")
    got = sorted((r.language, r.dependency) for r in file_ops.dependencies(df).collect())
    assert got == [("JavaScript", "express"), ("Python", "pytest>=7.0.0"), ("Python", "requests>=2.0.0")]


def test_long_numbers_still_start_a_record(spark):
    reply = "- Linha 123456789012345678901: big\n- Linha 7: small"
    df = spark.createDataFrame([(1, reply)], "doc_id long, response string")
    got = [(r.record, r.line, r.message) for r in replies.parse_suggestions(df).orderBy("record").collect()]
    assert got == [(0, None, "big"), (1, 7, "small")]


def test_projects_with_the_same_path_stay_apart(files, spark):
    df = files({"m.py": "x = 1"}).unionByName(files({"m.py": "y = 2"}, project="q"))
    asked = replies.prompts(df)
    assert {(r.project, r.path) for r in asked.collect()} == {("p", "m.py"), ("q", "m.py")}
    answers = asked.select("prompt_hash", F.concat(F.lit("- Linha 1: in "), "project").alias("response"))
    attached = replies.attach_responses(asked, answers)
    found = {(r.project, r.message) for r in replies.file_suggestions(attached).collect()}
    assert found == {("p", "in p"), ("q", "in q")}


def test_lint_output_that_cannot_be_read_is_set_aside(spark):
    good = '[{"type":"error","line":3,"message":"m","score":7.5},{"type":"info","line":1,"message":"n"}]'
    texts = [good, "[]", None, " \n", good[:-5], '{"a":1}', "null", "3", '[{"type":"error"},1]', "[null]",
             '[{"type":"error","line":"x","message":5,"more":[1]}]', '[{"type":"error","type":"warning"}]', "[[1]]"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project string, doc_id long, raw_json string")
    aside = {r.doc_id: (r.problem, r.raw_json) for r in replies.lint_quarantine(df).collect()}
    expected = {2: "empty", 3: "empty", 4: "no JSON", 5: "no list", 6: "no list", 7: "no list", 8: "no message",
                9: "no message", 11: "no JSON", 12: "no message"}
    assert aside == {i: (why, texts[i]) for i, why in expected.items()}
    rows = {r.doc_id: (r.score, r.warnings_count, r.errors) for r in replies.lint_checked_report(df).collect()}
    assert rows[0] == (7.5, 1, "3:m") and rows[1] == (0.0, 0, "") and rows.keys() == {0, 1, 10}
    strange = next(r.messages[0] for r in replies.lint_checked(df).collect() if r.doc_id == 10)
    assert (strange.type, strange.line, strange.message) == ("error", None, "5")
    well = df.filter("doc_id < 2")
    assert sorted(replies.lint_checked_report(well).collect()) == sorted(replies.lint_report(well).collect())


def test_completed_prompts_stay_in_arrow(spark):
    """A batch of prompts is not copied into Python strings."""
    from pyspark.util import PythonEvalType

    plan = QUERIES["completed_prompts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}\n" in plan
