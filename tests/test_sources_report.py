"""Reading a source tree, writing reports, session helpers."""

import pytest
from pyspark.sql import functions as F

from codeloom import session
from codeloom.operators import files as file_ops
from codeloom.plans import report
from codeloom.sources import repo_files, sinks, tree_source
from codeloom.sources.repo_files import scan_tree


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repos"
    content = {
        "one/src/main.py": b"def main():\r\n    print('Hello')\r\n", "one/a b+c.js": b"function helper() { return true; }",
        "one/.env": b"API_KEY=test", "one/pkg/__init__.py": b"", "top.py": b"x = 1", "one/.git/HEAD": b"ref", "one/pic.png": b"\x89PNG", "two/bad.txt": b"ol\xe1\rx\xff",
        "two/big.txt": b"x" * 200,
    }
    for path, data in content.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    return str(root)


def test_scan(spark, tree):
    got = {r.path: r for r in scan_tree(spark, tree, max_bytes=100, binaries=True).collect()}
    assert set(got) == {"one/src/main.py", "one/a b+c.js", "one/.env", "one/.git/HEAD", "one/pic.png", "one/pkg/__init__.py",
                        "two/bad.txt", "top.py"}
    main = got["one/src/main.py"]
    assert (main.project, main.ext, main.size) == ("one", ".py", 33)
    assert main.content == "def main():\n    print('Hello')\n"
    assert got["two/bad.txt"].content == "ol\nx"
    assert got["top.py"].project == "" and got["one/pkg/__init__.py"].content == ""
    assert scan_tree(spark, tree, glob="*.py").count() == 3


def test_scan_by_uri_is_the_same(spark, tree):
    assert sorted(scan_tree(spark, "file://" + tree).collect()) == sorted(scan_tree(spark, tree).collect())


def test_scan_opens_no_binary(spark, tree):
    import os

    os.chmod(f"{tree}/one/pic.png", 0)
    found = {r.path for r in scan_tree(spark, tree).collect()}
    assert "one/pic.png" not in found and "one/.git/HEAD" not in found
    assert {"one/pkg/__init__.py", "one/.env", "two/big.txt"} <= found


def test_scan_follows_no_link_to_a_directory(spark, tmp_path):
    """A link to a file is read, a cycle of directories is not entered."""
    (tmp_path / "p/a").mkdir(parents=True)
    (tmp_path / "p/a/one.py").write_text("x = 1\n")
    (tmp_path / "p/a/loop").symlink_to("..", target_is_directory=True)
    (tmp_path / "p/two.py").symlink_to("a/one.py")
    found = scan_tree(spark, str(tmp_path), failures=True).collect()
    assert sorted((r.path, r.content, r.error) for r in found) == [("p/a/one.py", "x = 1\n", None), ("p/two.py", "x = 1\n", None)]


def test_scan_goes_on_after_an_unreadable_file(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.py").write_text("x = 1\n")
    monkeypatch.setattr(repo_files, "_listing", lambda spark, uri: spark.createDataFrame(
        [("p/one.py", 6, None), ("p/gone.py", 5, None), ("p/shut", 0, "no entry")], "path string, size long, error string"))
    assert [r.path for r in scan_tree(spark, str(tmp_path)).collect()] == ["p/one.py"]
    found = {r.path: r for r in scan_tree(spark, str(tmp_path), failures=True).collect()}
    assert (found["p/one.py"].content, found["p/one.py"].error) == ("x = 1\n", None)
    assert found["p/gone.py"].content is None and "gone.py" in found["p/gone.py"].error
    assert (found["p/shut"].content, found["p/shut"].error) == (None, "no entry")


def test_scan_of_a_missing_tree_fails(spark, tmp_path):
    with pytest.raises(Exception):
        scan_tree(spark, str(tmp_path / "missing")).collect()


def test_scan_of_nothing(spark, tmp_path):
    assert scan_tree(spark, str(tmp_path)).count() == 0


def test_eligible(spark, tree):
    kept = file_ops.eligible_files(scan_tree(spark, tree))
    assert sorted(r.path for r in kept.collect()) == [
        "one/.env", "one/a b+c.js", "one/pkg/__init__.py", "one/src/main.py", "top.py", "two/bad.txt", "two/big.txt"]
    focused = file_ops.focused_files(kept, ["one/src/"])
    assert [r.path for r in focused.collect()] == ["one/src/main.py"]


def test_report_text(spark, files, tmp_path):
    df = files({"b.md": "# Projeto\n\nabc", "a.py": "class A:\n    def f(self):\n        return 1 or 2\n"})
    analyses = file_ops.analyse_files(df)
    summaries = spark.createDataFrame([("p", "b.md", "resumo")], "project string, path string, summary string")
    suggestions = spark.createDataFrame(
        [("p", "a.py", 1, 2, "nome", "g", None), ("p", "a.py", 0, 1, "doc", None, "clareza"),
         ("q", "a.py", 0, 1, "elsewhere", None, None)],
        "project string, path string, place long, line long, message string, suggested_code string, explanation string")
    lines = report.report_lines(analyses, summaries, suggestions)
    out = str(tmp_path / "report")
    sinks.write_report(lines, out)
    text = [r.value for r in spark.read.text(out).collect()]
    ordered = [r.line for r in lines.orderBy("project", "section", "path", "seq").collect()]
    assert sorted(text) == sorted(ordered)
    assert ordered == [
        "# Relatório de Análise do Projeto", "", "## Visão Geral", "- Total de arquivos: 2", "- Total de linhas: 5",
        "- Total de funções: 1", "- Total de classes: 1", "", "## Linguagens Utilizadas", "- Markdown: 1 arquivo(s)",
        "- Python: 1 arquivo(s)", "", "## Análises de Arquivos", "",
        "### a.py", "- Linguagem: Python", "- Linhas totais: 4", "- Linhas em branco: 1", "- Linhas de conteúdo: 3",
        "- Tamanho máximo de linha: 21", "- Tamanho médio de linha: 11.2", "- Complexidade: 2.0",
        "", "#### Sugestões de Melhoria", "- Linha 1: doc", "  Explicação: clareza", "- Linha 2: nome", "  Sugestão: g",
        "### b.md", "- Linguagem: Markdown", "- Linhas totais: 3", "- Linhas em branco: 1", "- Linhas de conteúdo: 2",
        "- Tamanho máximo de linha: 9", "- Tamanho médio de linha: 4.0", "", "#### Resumo do Arquivo", "resumo",
    ]
    quirk = [r.line for r in report.report_lines(analyses, compat=True).collect()]
    assert "- Linhas totais: 3" in quirk and "- Linhas em branco: 1" not in quirk


def test_stored_corpus(spark, files, tmp_path):
    from codeloom.sources.tables import corpus

    path = str(tmp_path / "corpus")
    files({"a.py": "x = 1", "b.js": "y"}).write.parquet(path)
    sizes = corpus(spark, path).filter(F.col("ext") == ".py").select("path", "size")
    assert [tuple(r) for r in sizes.collect()] == [("a.py", 5)]
    assert "content" not in sizes._jdf.queryExecution().executedPlan().toString()


def test_documents_sink(spark, tmp_path):
    df = spark.createDataFrame([("p", "{}"), ("q", '{"a":1}')], "project string, json string")
    sinks.write_documents(df, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 2


def test_shared_dir_is_the_named_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = session.cut_lineage(spark.range(5).withColumn("part", F.spark_partition_id()), "t")
    assert kept.count() == 5
    assert all(session.shared_dir(spark) in name for name in kept.inputFiles())


def test_only_local_sessions_get_a_folder_of_their_own():
    from types import SimpleNamespace

    def unset(master):
        context = SimpleNamespace(master=master, applicationId="app-" + master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    local = unset("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    with pytest.raises(ValueError):
        session.shared_dir(unset("spark://host:7077"))


def opened(spark, root, **options):
    tree_source.register(spark)
    return spark.read.format(tree_source.NAME).options(**options).load(root)


@pytest.mark.parametrize("size", [1, 70_000, 1 << 30])
def test_the_data_source_gives_what_the_scan_gives(spark, tree, size):
    """Whatever the stretches, down to one file each."""
    expected = scan_tree(spark, tree, failures=True)
    got = opened(spark, tree, partitionBytes=size)
    assert got.rdd.getNumPartitions() == (7 if size == 1 else 1 if size == 1 << 30 else 7)
    columns = ["project", "path", "ext", "size", "content", "error"]
    assert sorted(got.collect()) == sorted(expected.select(columns).collect(), key=lambda r: tuple(r)[:2])


def test_the_data_source_applies_pushed_comparisons_before_it_opens_a_file(spark, tree, capsys):
    import os

    os.chmod(f"{tree}/two", 0)
    os.chmod(f"{tree}/one/a b+c.js", 0)
    found = opened(spark, tree).filter("ext IN ('.py', '.x') AND size > 0 AND size <= 33 AND project = 'one'")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(project,one)" in plan and "LessThanOrEqual(size,33)" in plan and "In(ext" in plan
    assert [(r.path, r.error) for r in found.collect()] == [("one/src/main.py", None)]
    os.chmod(f"{tree}/two", 0o755)
    # What cannot be pushed is left to Spark.
    rest = opened(spark, tree).filter("length(content) = 5 AND (ext = '.py' OR size = 5) AND ext <> '.js'")
    assert [r.path for r in rest.collect()] == ["top.py"]


def test_the_data_source_survives_cycles_and_what_is_gone(spark, tmp_path):
    (tmp_path / "p/a").mkdir(parents=True)
    (tmp_path / "p/a/one.py").write_text("x = 1\n")
    (tmp_path / "p/a/loop").symlink_to("..", target_is_directory=True)
    (tmp_path / "p/nowhere.py").symlink_to("gone")
    rows = {r.path: r for r in opened(spark, str(tmp_path)).collect()}
    assert rows["p/a/one.py"].content == "x = 1\n" and len([p for p in rows if "loop" in p]) == 0
    assert all(r.error for p, r in rows.items() if p == "p/nowhere.py")
    (tmp_path / "empty").mkdir()
    assert opened(spark, str(tmp_path / "empty")).collect() == []


def test_every_stretch_lists_its_own_part_only(tmp_path):
    import random

    rng = random.Random(5)
    for k in range(120):
        at = tmp_path.joinpath(*[rng.choice(["a", "a.b", "a-b", "b", "é"]) for _ in range(rng.randint(0, 4))], f"f{k}.py")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * rng.randint(0, 300))
    walker = tree_source.Tree({"path": str(tmp_path), "partitionbytes": str(tree_source.OPEN_BYTES * 5)})
    wanted = tree_source.Wanted()
    whole = [f.path for f in walker.walk(wanted, tree_source.Stretch())]
    parts = walker.stretches(wanted, tree_source.Stretch())
    assert len(whole) == 120 and len(parts) >= 24
    assert [f.path for part in parts for f in walker.walk(wanted, part)] == whole


def test_the_data_source_as_a_stream_gives_each_file_once(spark, tmp_path):
    import os

    root, out, check = tmp_path / "tree", str(tmp_path / "out"), str(tmp_path / "check")
    tree_source.register(spark)

    def put(name, text, changed):
        (root / "p").mkdir(parents=True, exist_ok=True)
        (root / "p" / name).write_text(text)
        os.utime(root / "p" / name, (changed, changed))

    def run():
        stream = spark.readStream.format(tree_source.NAME).option("settleSeconds", 0).load(str(root))
        stream.filter("ext = '.py'").writeStream.format("parquet").option("checkpointLocation", check).trigger(
            availableNow=True).start(out).awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.parquet(out).collect())

    put("a.py", "1", 1000)
    put("b.txt", "2", 1001)
    assert run() == [("p/a.py", "1")]
    put("c.py", "3", 1002)
    assert run() == run() == [("p/a.py", "1"), ("p/c.py", "3")]
    put("a.py", "4", 1003)
    os.remove(root / "p/c.py")
    assert run() == [("p/a.py", "1"), ("p/a.py", "4"), ("p/c.py", "3")]
