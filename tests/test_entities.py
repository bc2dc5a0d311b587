"""Entities from indentation against the standard parser."""

import ast
import email
import json
import textwrap
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from codeloom.functions import python_source
from codeloom.functions.python_scan import masked_text
from codeloom.operators import entities
from codeloom.sources import derived
from conftest import DATA

DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def branches(node, kinds):
    return sum(isinstance(n, kinds) for n in ast.walk(node)) + sum(
        len(n.values) - 1 for n in ast.walk(node) if isinstance(n, ast.BoolOp)
    )


def parsed(source):
    rows = {}
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, DEF):
            rows[n.lineno] = ("function", n.name, n.end_lineno, len(n.args.args),
                              branches(n, (ast.If, ast.For, ast.While, ast.Try)), None, None)
        elif isinstance(n, ast.ClassDef):
            methods = ",".join(c.name for c in n.body if isinstance(c, DEF))
            targets = sum(len(c.targets) for c in n.body if isinstance(c, ast.Assign))
            rows[n.lineno] = ("class", n.name, n.end_lineno, None, None, methods, targets)
    return rows


def found(df):
    rows = {}
    for r in entities.code_entities(df).collect():
        methods = None if r.methods is None else ",".join(r.methods)
        rows.setdefault(r.path, {})[r.start_line] = (
            r.kind, r.name, r.end_line, r.params, r.complexity, methods, r.attributes)
    return rows


def file_complexity(source):
    tree = ast.parse(source)
    kinds = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.AsyncWith, ast.ExceptHandler)
    return 1.0 + branches(tree, kinds)


HARD = {
    "signature.py": '''
        def wide(
            a, b=(1, 2),
            *rest: int, key=None, **more
        ):
            return a

        def positional(a, b, /, c, d): pass
        def star(a, *, b): return lambda x, y: x
        def fancy(a=lambda p, q: p, b: dict[str, int] = {}, c=")"): pass
        class Empty: pass
        class Inline(Empty): x = 1; y = z = 2
        ''',
    "strings.py": '''
        class Docs(Base, metaclass=Meta):
            """Has a
        def fake(): pass
            # no comment
            """
            text = "def no(): # if and or"
            a, b = 1, 2
            c = d = 3
            e: int = 4
            f += 5
            g[0] = h.i = [k for k in range(3) if k == 1 or k]
            (m, n) = call(x=1)

            def real(self):
                return \'\'\'ends
        here\'\'\'
        # trailing comment

            # other

            async def later(self, ação): return 1
        ''',
    "blocks.py": '''
        def outer(x):
            def inner(y):
                if y and x:
                    return 1
                elif y or (x and
                           y):
                    for i in range(3): pass
                while x: break
                try:
                    pass
                except ValueError: pass
                else: pass
            total = [
                a
                for a in x
                if a
            ]
            value = 1 if x else 2
            long = x \\
        or total

            return (inner,
        total)

        async def other():
            async for a in b:
                async with a: pass
            with open("x") as f, g: pass
        ''',
    "groups.py": '''
        def f():
            try:
                try:
                    pass

                except ValueError: pass
            except* OSError:
                pass
            try: pass
            except* (KeyError,
        TypeError): pass
            try:
                x = 1
            finally:
                pass
        ''',
    "tabs.py": "class T:\n\tdef a(self):\n\t\tif 1:\n\t\t\treturn\n\n\tdef b(self): pass\n\n\nx = 1\n",
    "unicode.py": "def ação(número, ß):\n    andé = 1\n    return número and ß\n",
    "empty.py": "",
    "last.py": "def f():\n    pass",
}


@pytest.fixture
def hard():
    return {k: textwrap.dedent(v) for k, v in HARD.items()}


def test_hard_cases(files, hard):
    got = found(files(hard))
    for path, source in hard.items():
        assert got.get(path, {}) == parsed(source), path


def test_hard_file_complexity(files, hard):
    got = {r.path: r.complexity for r in entities.python_complexity(files(hard)).collect()}
    assert got == {path: file_complexity(source) for path, source in hard.items()}


def test_standard_library(files):
    folders = [Path(json.__file__).parent, Path(email.__file__).parent]
    sources = {str(p): p.read_text("utf-8", "ignore") for folder in folders for p in sorted(folder.glob("*.py"))}
    df = files(sources).repartition(8)
    got = found(df)
    for path, source in sources.items():
        assert got.get(path, {}) == parsed(source), path
    complexity = {r.path: r.complexity for r in entities.python_complexity(df).collect()}
    assert complexity == {path: file_complexity(source) for path, source in sources.items()}


def test_derived_corpus_parses(spark):
    df = derived.python_files(spark, DATA)
    got = found(df)
    for row in df.select("path", "content").collect():
        assert got[row.path] == parsed(row.content), row.path


FORMAT = {
    "plain.py": 'def f(a):\n    return f"{a and 1}" or 2\n',
    "literal.py": 'def f(a):\n    return f"and {{a or b}} or {a}" + rf"\\{a or 1}" + f"\\N{DIGIT ONE} or {a or 2}"\n',
    "nested.py": """def f(a, b):
    return f"{a and f'{b or {1: f"{a or b}"}[1]}'!r:>{a or 3}.{b and 2}} and" f'{a:{"and" or "or"}}'
""",
    "lines.py": """def f(a):
    x = f'''one {a
        and [1,
             (a or
              2)]} or
    def no(): # and {a!r:and or}
    '''
    return x if a and x else f'{"}" or a}{a != 1 or "{"}'
""",
    "fields.py": "def f(a):\n    return f'{(lambda x: x and a)(1):and}{a[1:2] or (b := 3)}{ {1: a or 2}[1] =}'\n",
    "joined.py": "def f(a):\n    x = (f'{a or 1}' 'and'\n  f'{a and 2}')\n    return x\n",
}


def test_operators_inside_format_strings(files):
    """As the parser sees them, which looks into the fields and their specifications."""
    df = files(FORMAT)
    got = found(df)
    complexity = {r.path: r.complexity for r in entities.python_complexity(df).collect()}
    for path, source in FORMAT.items():
        assert got[path] == parsed(source), path
        assert complexity[path] == file_complexity(source), path


def test_brackets_of_any_depth(files):
    depth = 60
    source = "def f(a, b=" + "(\n" * depth + "a and 1" + ",)" * depth + ", *c):\n    x = y = "
    source += "[\n" * depth + "a or (a and\n1)" + "]" * depth + "\n    return x\n\n\nclass C:\n    d = e[f[g[1]]] = {1: (2, [3])}\n"
    assert found(files({"deep.py": source}))["deep.py"] == parsed(source)


@pytest.mark.parametrize("text", ["f'{", "f'{a", "f'{a:", "'''", "f'''{'", "(((", ")))]", "\\", "'\\", "f'{{", "rf'\\"])
def test_a_mask_of_broken_text_ends(text):
    assert isinstance(masked_text("x = 1\n" + text), str)


def test_broken_file_falls_back(files):
    """No entities, and complexity and names by pattern."""
    from codeloom.operators import files as file_ops

    source = "def f(:\n    if a and b else c\n"
    with pytest.raises(SyntaxError):
        ast.parse(source)
    df = files({"f.py": source, "nul.py": "x = 1\0", "ok.py": "if a: pass\n"})
    assert found(df) == {}
    complexity = {r.path: r.complexity for r in entities.python_complexity(df).collect()}
    assert complexity == {"f.py": 3.0, "nul.py": 1.0, "ok.py": 2.0}
    analysed = {r.path: (r.complexity, r.functions) for r in file_ops.analyse_files(df).collect()}
    assert analysed == {"f.py": (3.0, ["f"]), "nul.py": (1.0, []), "ok.py": (2.0, [])}


def test_long_function_does_not_overflow(files):
    source = "def f():\n" + "    x = (1,\n  2)\n" * 60_000
    assert found(files({"f.py": source}))["f.py"][1][2] == 120_001


def test_deep_indentation_and_nesting(files):
    """A body indented by 200 blanks, and brackets nested eleven deep over lines."""
    deep = " " * 200
    nested = "def f(a):\n    x = " + "".join(f"{'(' if i % 2 else '['}\n" for i in range(11)) + "a and a\n"
    nested += "".join(f"{')' if i % 2 else ']'}\n" for i in reversed(range(11))) + "    return x\n"
    df = files({"deep.py": f"class C:\n{deep}def m(self):\n{deep}    pass\n", "nested.py": nested})
    found = {(r.path, r.name): r for r in entities.code_entities(df).collect()}
    assert found["deep.py", "C"].methods == ["m"]
    assert (found["nested.py", "f"].end_line, found["nested.py", "f"].complexity) == (nested.count("\n"), 1)


def test_texts_are_scanned_in_pieces(monkeypatch):
    """A batch of many texts comes back in several parts, so that few results are held at a time."""
    monkeypatch.setattr(python_source, "PIECE_BYTES", 40)
    texts = pa.array(["x = 1  # a\n" * 2, None, "def f(:\n", "y = 'b'\n" * 9, ""])
    run = python_source._text_udf(python_source._accepts, pa.bool_(), T.BooleanType())
    parts = list(run.func(iter([texts])))
    assert len(parts) > 1
    assert [v for p in parts for v in p.to_pylist()] == [True, False, False, True, True]


def test_prefixes_of_strings_are_found_behind_the_quote():
    """A word that runs into a quote starts no string; one or two prefix letters do."""
    assert masked_text("x = rb'a#b' + f'{p and q}'\n") == "x = '' + '' and \n"
    assert masked_text("abf'a' # c\n") == masked_text("abf'a' \n")
    assert masked_text("g(a, h(b and c, 'd'))\n") == "g(a, h and )\n"
