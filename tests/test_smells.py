"""Rules at their thresholds, duplicates against brute force, project roll-up."""

import json
import random

import numpy as np
import pytest

from codeloom.operators import duplicates, entities, smells
from codeloom.plans import report
from codeloom.settings import Thresholds


def hits(df):
    found = smells.entity_smells(entities.code_entities(df)).collect()
    return sorted((r.path, r.line, r.type, r.severity, r.message) for r in found)


def method(lines):
    return "def f():\n" + "    x = 1\n" * lines


def klass(methods=0, attributes=0, prefix="m"):
    body = [f"    a{i} = {i}" for i in range(attributes)]
    body += [f"    def {prefix}{i}(self): pass" for i in range(methods)]
    return "class C:\n" + "\n".join(body or ["    pass"]) + "\n"


def test_thresholds_are_strict(files):
    df = files({
        "len30.py": method(30), "len31.py": method(31),
        "par5.py": "def f(a, b, c, d, e): pass\n", "par6.py": "def f(a, b, c, d, e, f): pass\n",
        "cx10.py": "def f():\n" + "    if a: pass\n" * 10, "cx11.py": "def f():\n" + "    if a: pass\n" * 11,
        "cl300.py": "class C:\n    def m(self): pass\n" + "    x = 1\n" * 0 + "    x(1)\n" * 299,
        "cl301.py": "class C:\n    def m(self): pass\n" + "    x(1)\n" * 300,
        "data.py": klass(1, 1, prefix="__m"), "nodata.py": klass(1, 1, prefix="_m"),
        "god20.py": klass(20), "god21.py": klass(21), "att15.py": klass(1, 15), "att16.py": klass(1, 16),
    })
    assert hits(df) == [
        ("att16.py", 1, "god_class", 3, "Classe com muitas responsabilidades"),
        ("cl301.py", 1, "large_class", 2, "Classe muito grande (301 linhas)"),
        ("cx11.py", 1, "high_complexity", 3, "Complexidade muito alta (11)"),
        ("data.py", 1, "data_class", 1, "Classe apenas com atributos e getters/setters"),
        ("god21.py", 1, "god_class", 3, "Classe com muitas responsabilidades"),
        ("len31.py", 1, "long_method", 2, "Método muito longo (31 linhas)"),
        ("par6.py", 1, "long_parameter_list", 1, "Método com muitos parâmetros (6)"),
    ]


def test_lower_limits(files):
    df = files({"a.py": "def f(a, b):\n    if a: pass\n"})
    low = Thresholds(max_method_lines=0, max_complexity=0, max_parameters=1)
    found = smells.entity_smells(entities.code_entities(df), low).collect()
    assert sorted(r.type for r in found) == ["high_complexity", "long_method", "long_parameter_list"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(content, n=6, least=0.8):
    bare = ["" if line.strip().startswith("#") else line.strip() for line in content.split("\n")]
    blocks = [" ".join(line for line in bare[i:i + n] if line) for i in range(len(bare))]
    out = set()
    for i, a in enumerate(blocks):
        for b in blocks[i + n:]:
            if a and b and 1.0 - distance(a, b) / max(len(a), len(b)) >= least:
                out.add(i + 1)
                break
    return out


@pytest.fixture(scope="module")
def sources():
    random.seed(3)
    words = ["alpha", "beta", "x", "y9", "é", "total", "value_1", "'🙂'"]
    made = {}
    for k in range(12):
        lines = [" - ".join(random.choices(words, k=random.randint(0, 4))) for _ in range(random.randint(1, 40))]
        lines = ["# note" if random.random() < 0.1 else line for line in lines]
        tail = [line.replace("a", "o") if random.random() < 0.3 else line for line in lines[:15]]
        made[f"f{k}.py"] = "\n".join(lines + tail)
    made["same_a.py"] = made["same_b.py"] = made["f0.py"]
    call = "( a, b, c, d )"
    made["split_call.py"] = "\n".join([f"f{call}"] + [""] * 5 + ["f(", "a,", "b,", "c,", "d", ")"])
    made["blanks.py"] = "\n".join(["(a, b, c, d, e, f)"] + [""] * 5 + ["(a,", "b,", "c,", "d,", "e,", "f)"])
    made["comments.py"] = "# a\n" * 20
    made["exact.py"] = "\n".join(["abcde"] + ["#"] * 5 + ["abcdx"])
    made["below.py"] = "\n".join(["abcd"] + ["#"] * 5 + ["abcx"])
    made["one_long.py"] = "x = 1\n" * 70
    made["broken.py"] = "x = (\n" * 70
    return made


@pytest.mark.parametrize("tile", [4, 1024])
def test_duplicates_equal_brute_force(files, sources, tile):
    got = {}
    for r in duplicates.duplicate_lines(files(sources), tile=tile).collect():
        assert r.line not in got.setdefault(r.path, set()), "a line is reported once"
        got[r.path].add(r.line)
    expected = {path: brute_force(text) for path, text in sources.items() if path != "broken.py"}
    assert got == {path: lines for path, lines in expected.items() if lines}
    assert 1 in got["exact.py"] and "below.py" not in got
    assert 1 in got["split_call.py"] and 1 in got["blanks.py"]


def test_project_documents(files):
    df = files({"a.py": klass(0, 16) + "# c\n\n", "b.py": "x = 1\n"})
    found = entities.code_entities(df)
    every = smells.all_smells(smells.entity_smells(found), duplicates.duplicate_smells(df))
    metrics = smells.project_metrics(df, found, every)
    row = metrics.first()
    severity = sum(r.severity for r in every.collect())
    assert (row.total_lines, row.code_lines, row.blank_lines) == (20, 18, 1)
    assert (row.total_functions, row.total_classes, row.density) == (0, 1, severity / 18)
    documents = [json.loads(r.json) for r in report.project_documents(metrics, every).collect()]
    assert sum("complexity" in d for d in documents) == 1
    assert {"data_class", "god_class"} <= {d.get("type") for d in documents}


def test_no_code_lines_gives_zero_density(files):
    df = files({"a.py": "# only\n"})
    found = entities.code_entities(df)
    assert smells.project_metrics(df, found, smells.entity_smells(found)).first().density == 0.0


def test_density_counts_python_only(files):
    df = files({"a.py": "class C:\n    x = 1\n", "b.md": "# t\n\nabc\nabc\n"})
    found = entities.code_entities(df)
    row = smells.project_metrics(df, found, smells.entity_smells(found)).first()
    assert (row.code_lines, row.severity, row.density) == (2, 1, 0.5)


def test_staged_answers_give_the_same(files, sources):
    from codeloom.functions.python_source import parses
    from pyspark.sql import functions as F

    df = files(sources)
    staged = df.withColumn("parsed", parses(F.col("content")))
    assert sorted(duplicates.duplicate_lines(staged).collect()) == sorted(duplicates.duplicate_lines(df).collect())


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_side_by_side():
    made = ["".join(random.choice("abé€") for _ in range(random.randint(1, 160))) for _ in range(25)]
    made = list(dict.fromkeys(made + [t[:len(t) // 2] + "x" + t[len(t) // 2 + 1:] + "y" for t in made]))
    length = np.array([len(t) for t in made])
    a, b = (np.array(p) for p in zip(*[(i, j) for i in range(len(made)) for j in range(len(made)) if i != j][::5]))
    most = np.maximum(length[a], length[b]) // 4
    near = abs(length[a] - length[b]) <= most
    a, b, most = a[near], b[near], most[near]
    for x, y, bound, got in zip(a, b, most, duplicates.distances(made, a, b, most)):
        expected = plain_distance(made[x], made[y])
        assert got == expected if expected <= bound else got > bound


def test_duplicate_search_compares_rows_in_place(files, sources):
    """No pair of blocks is a row of a join, and no block is one of a shuffle."""
    plan = duplicates.duplicate_lines(files(sources))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
