"""Ignore rules against a plain matcher."""

import fnmatch
import random

import pytest

from codeloom.operators import ignore_rules


def matches(pattern, names):
    """Whether all of `names` match the parts of a pattern."""
    if not pattern:
        return not names
    if pattern[0] == "**":
        if len(pattern) == 1:
            return len(names) > 0
        return any(matches(pattern[1:], names[k:]) for k in range(len(names) + 1))
    return bool(names) and fnmatch.fnmatchcase(names[0], pattern[0]) and matches(pattern[1:], names[1:])


def plain(path, rules):
    names = path.split("/")
    for k in range(1, len(names) + 1):
        state = False
        for depth in range(k):
            for line in rules.get("/".join(names[:depth]), "").split("\n"):
                if not line.strip() or line.startswith("#"):
                    continue
                back, bare = line.startswith("!"), line.removeprefix("!")
                if bare.endswith("/") and k == len(names):
                    continue
                inner = bare.rstrip("/")
                below = names[depth:k]
                hit = matches(inner.removeprefix("/").split("/"), below) if "/" in inner else fnmatch.fnmatchcase(below[-1], inner)
                state = not back if hit else state
        if state:
            return True
    return False


def ignored(spark, paths, rules):
    files = spark.createDataFrame([("p", path) for path in paths], "project string, path string")
    table = spark.createDataFrame([("p", b, t) for b, t in rules.items()], "project string, base string, rules string")
    return sorted(r.path for r in ignore_rules.ignored_by_rules(files, table).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_a_plain_matcher(spark, seed):
    rng = random.Random(seed)
    folders, endings = ["a", "b", "ab", "a.b", "é"], ["x.js", "x.min.js", "y.txt", "a", "b+c"]
    paths = sorted({"/".join([*rng.choices(folders, k=rng.randint(0, 4)), rng.choice(endings)]) for _ in range(300)})
    patterns = ["*.js", "!*.min.js", "a/", "/a", "/a/*", "!/a/b", "**/b", "a/**", "a/**/b", "!a", "?.txt", "b+c", "[ab]",
                "[!a]b", "# a", "", "x*", "/**/ab/", "!y.txt", "a.b/", "*", "!*/"]
    rules = {base: "\n".join(rng.sample(patterns, 4)) for base in ["", "a", "b", "a/b", "ab/a.b", "é"]}
    got = ignored(spark, paths, rules)
    assert got == [path for path in paths if plain(path, rules)] and 0 < len(got) < len(paths)


def test_hard_signs(spark):
    paths = ["#a", "!b", "c*d", "cxd", "e[1", "f(x|y)$.z", "sp ", "g", "dir/g", "t\\", "k/[z-a]"]
    assert ignored(spark, paths, {"": "\\#a\n\\!b\nc\\*d\ne[1\nf(x|y)$.z\r\nsp\\ \n/g  \n[z-a]\n!\n/\n"}) == sorted(
        ["#a", "!b", "c*d", "e[1", "f(x|y)$.z", "sp ", "g", "k/[z-a]"])


def test_edges(spark):
    files = spark.createDataFrame(
        [("p", "a/x", 1), ("p", "a/x", 2), ("q", "a/x", 3), (None, "a/x", 4), ("p", None, 5), ("p", "", 6)],
        "project string, path string, rules int")
    rules = spark.createDataFrame([("p", "", "a"), (None, "", "a"), ("p", "a", None), ("q", None, "a")],
                                  "project string, base string, rules string")
    assert [tuple(r) for r in ignore_rules.ignored_by_rules(files, rules).collect()] == [("p", "a/x")]
    kept = ignore_rules.kept_by_rules(files, rules)
    assert kept.columns == files.columns and sorted(r.rules for r in kept.collect()) == [3, 4, 5, 6]
    assert ignore_rules.ignored_by_rules(files.limit(0), rules).count() == 0
    assert ignore_rules.ignored_by_rules(files, rules.limit(0)).count() == 0
