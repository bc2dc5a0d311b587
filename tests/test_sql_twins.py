"""Every query against its SQL twin on the small tables."""

import decimal
import importlib.util
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from conftest import DATA

_spec = importlib.util.spec_from_file_location(
    "spark_entry", Path(__file__).resolve().parent.parent / "__spark_entry__.py"
)
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    return float(value) if isinstance(value, decimal.Decimal) else value


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) == set(entry.ORACLE)


@pytest.mark.parametrize("without", [("codeloom/llm",), ("codeloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_a_copy_without_the_optional_parts_has_all_other_queries(tmp_path, without):
    root = Path(__file__).resolve().parent.parent
    left_out = {str(root / name) for name in without}
    shutil.copytree(root / "codeloom", tmp_path / "codeloom", ignore=lambda at, names: [
        n for n in names if f"{at}/{n}" in left_out or n == "__pycache__"])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if str(root / name) not in left_out:
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": ""})
    names, twins = json.loads(run.stdout)
    more = set() if "codeloom/llm" in without else {n for n in entry.LLM_QUERIES if n != "pipeline"}
    assert set(names) == set(entry.QUERIES) | more
    assert set(entry.ORACLE) <= set(twins) <= set(names)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    given = [d[0] for d in cursor.description]
    assert sorted(given) == columns
    order = [given.index(c) for c in columns]
    theirs = sorted((tuple(plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["project", "path", "line", "type", "severity", "message", "suggestion"]
