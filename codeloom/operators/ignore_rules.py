"""Ignore rules kept in folders: the deepest folder's last matching rule decides.

Rules are a table of one row per rule file: `project`, `base` (the folder it
lies in, "" for the root) and `rules`, its lines. A line is blank, a comment
(`#`), or a pattern; `!` takes back what an earlier or a higher one ignored, a
closing `/` means folders only. A pattern with a `/` in front or inside is
matched from its folder on, any other against names at any depth. `*` and `?`
do not cross a `/`, `**` does; a bracket class holds letters, digits, `_`, `.`
and the ranges a-z, A-Z, 0-9, any other bracket is the character itself; a
backslash takes the meaning from the next character. What lies in an ignored
folder is ignored, and nothing below can take that back.

Every folder is decided once, not once for each file in it. Folders and files
meet the rule files of their ancestors by equality of project and folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stand-ins while a pattern is spelled out; no rule file holds these characters.
OPEN, OPEN_NOT, CLOSE, ANY_FOLDERS, ALL_BELOW = "\x01", "\x02", "\x03", "\x04", "\x05"
MEMBERS = r"((?:a-z|A-Z|0-9|[A-Za-z0-9_.])+)"


def _regex(pattern: Column) -> Column:
    """The pattern of a rule, without signs at its ends, as a regular expression."""
    steps = [
        ("[\x01-\x05]", ""),
        (r"^((?:[^\\]|\\.)*)\\$", "$1"),
        (r"\\([A-Za-z0-9])", "$1"),
        (rf"(?<!\\)\[[!^]{MEMBERS}\]", f"{OPEN_NOT}$1{CLOSE}"),
        (rf"(?<!\\)\[{MEMBERS}\]", f"{OPEN}$1{CLOSE}"),
        (r"(?<!\\)([.^$+(){}|\[\]])", r"\\$1"),
        (r"^(?:\*\*/)+", ANY_FOLDERS),
        (r"/(?:\*\*/)+", f"/{ANY_FOLDERS}"),
        (r"/\*\*$", f"/{ALL_BELOW}"),
        (r"(?<!\\)\*+", "[^/]*"),
        (r"(?<!\\)\?", "[^/]"),
        (OPEN_NOT, "[^/"), (OPEN, "["), (CLOSE, "]"), (ANY_FOLDERS, "(?:.*/)?"), (ALL_BELOW, ".+"),
    ]
    for old, new in steps:
        pattern = F.regexp_replace(pattern, F.lit(old), F.lit(new))
    return pattern


def parsed_rules(rules: DataFrame) -> DataFrame:
    """project, base, and the rules of each file in order: taken_back, folders_only, regex."""
    def rule(line: Column) -> Column:
        taken_back = line.startswith("!")
        bare = F.when(taken_back, F.substr(line, F.lit(2))).otherwise(line)
        folders_only = bare.endswith("/")
        inner = F.regexp_replace(bare, "/+$", "")
        anchored = F.contains(inner, F.lit("/"))
        body = _regex(F.regexp_replace(inner, "^/", ""))
        regex = F.concat(F.when(anchored, F.lit("(?s)^")).otherwise(F.lit("(?s)^(?:.*/)?")), body, F.lit("$"))
        return F.struct(taken_back.alias("taken_back"), folders_only.alias("folders_only"), regex.alias("regex"))

    lines = F.transform(F.split("rules", r"\r?\n"), lambda line: F.regexp_replace(line, r"(?<!\\)[ \t]+$", ""))
    filled = F.filter(lines, lambda line: ~line.startswith("#") & ~line.rlike("^!?/*$"))
    return rules.select("project", "base", F.transform(filled, rule).alias("rules")).filter(F.size("rules") > 0)


def _decision(rules: Column, path: Column, folder: Column) -> Column:
    """Whether the last matching rule ignores the path; null if none matches."""
    def last(found: Column, rule: Column) -> Column:
        hit = (folder | ~rule["folders_only"]) & F.regexp_like(path, rule["regex"])
        return F.when(hit, ~rule["taken_back"]).otherwise(found)

    return F.aggregate(rules, F.lit(None).cast("boolean"), last)


def _entries(files: DataFrame) -> DataFrame:
    """Each file with itself and every folder above it: project, path, entry, folder."""
    names = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.struct(
        F.array_join(F.slice(names, F.lit(1), k), "/").alias("entry"), (k < F.size(names)).alias("folder")))
    return files.select("project", "path", F.explode(upto).alias("e")).select("project", "path", "e.*")


def ignored_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """project and path of the files that rules ignore, each once.

    A row without a project or a path is matched by nothing; other columns are
    not read. There is one rule file to a folder; if a table holds several, what
    any of them ignores at that depth is ignored.
    """
    entries = _entries(files.select("project", "path"))
    one = entries.select("project", "entry", "folder").distinct()
    names = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.struct(
        F.array_join(F.slice(names, F.lit(1), k), "/").alias("base"), k.alias("depth"),
        F.array_join(F.slice(names, k + 1, F.size(names)), "/").alias("below")))
    met = one.select("project", "entry", "folder", F.explode(above).alias("a")).select(
        "project", "entry", "folder", "a.*").join(parsed_rules(rules), ["project", "base"])
    decided = met.withColumn("ignored", _decision(F.col("rules"), F.col("below"), F.col("folder"))).filter(
        F.col("ignored").isNotNull())
    last = decided.groupBy("project", "entry", "folder").agg(
        F.max(F.struct("depth", "ignored"))["ignored"].alias("ignored"))
    return entries.join(last.filter("ignored"), ["project", "entry", "folder"], "left_semi").select(
        "project", "path").distinct()


def kept_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """`files` without those that rules ignore."""
    return files.join(ignored_by_rules(files, rules), ["project", "path"], "left_anti").select(files.columns)
