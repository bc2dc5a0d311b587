"""Filters, per-file analysis and project roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import settings
from codeloom.functions import keys, paths, text
from codeloom.functions import python_source as py


def is_binary_name(ext: Column) -> Column:
    return ext.isin(settings.BINARY_EXTENSIONS)


def in_repository_data(path: Column) -> Column:
    return F.contains(F.concat(F.lit("/"), path), F.lit("/.git/"))


def eligible_files(files: DataFrame, max_bytes: int = settings.MAX_FILE_BYTES) -> DataFrame:
    """Files worth analysing: not binary by name, not repository data, not huge."""
    return files.filter(
        ~is_binary_name(F.col("ext")) & ~in_repository_data(F.col("path")) & (F.col("size") <= max_bytes)
    )


def ignored_files(files: DataFrame, globs=tuple(settings.IGNORE_PATTERNS)) -> DataFrame:
    """Files an ignore glob or a skipped directory takes out."""
    return files.filter(paths.is_ignored(F.col("path"), globs))


def focused_files(files: DataFrame, directories: list[str]) -> DataFrame:
    return files.filter(paths.in_directories(F.col("path"), directories))


def file_roles(files: DataFrame, patterns=None) -> DataFrame:
    """One row per file and role."""
    found = paths.roles(F.col("path"), patterns or settings.ROLE_PATTERNS)
    return files.select("project", "path", F.explode(found).alias("role"))


def language_counts(files: DataFrame, languages=None) -> DataFrame:
    """Files per project and language."""
    lang = paths.language(F.col("ext"), languages or settings.LANGUAGE_OF_EXTENSION)
    return files.groupBy("project", lang.alias("language")).agg(F.count("*").alias("files"))


def line_metrics(files: DataFrame, *more: str) -> DataFrame:
    """Total, blank and code lines, longest and mean line of every file; `more` columns are kept."""
    content = F.col("content")
    counted = files.select(
        "project", "path", "ext", "size", "content", *more,
        (text.newline_count(content) + 1).alias("total_lines"),
        text.blank_line_count(content).alias("blank_lines"),
        text.max_line_length(content).alias("max_line_length"),
        text.average_line_length(content).alias("avg_line_length"),
    )
    return counted.withColumn("code_lines", F.col("total_lines") - F.col("blank_lines"))


def analyse_files(files: DataFrame, languages=None) -> DataFrame:
    """Metrics, complexity and entity names of every file, by language.

    Python is read by its block structure, text has no complexity or names,
    all other files, and Python that does not parse, are judged by keyword
    and name patterns.
    """
    content = F.col("content")
    lang = paths.language(F.col("ext"), languages or settings.LANGUAGE_OF_EXTENSION)
    is_python = F.col("parsed")
    is_text = paths.is_text_language(F.col("language"))
    none = F.array().cast("array<string>")
    named = files.withColumn("language", lang)
    # Only Python goes through Python.
    python = F.coalesce(F.col("language") == "Python", F.lit(False))
    scanned = named.filter(python).withColumn("scan", py.scanned(files))
    judged = scanned.withColumns({"parsed": F.col("scan.parsed"), "mask": F.col("scan.mask")}).drop("scan").unionByName(
        named.filter(~python).withColumns({"parsed": F.lit(False), "mask": F.lit(None).cast("string")}))
    staged = line_metrics(judged, "language", "parsed", "mask")
    mask = F.col("mask")

    def heads(word: str):
        return F.regexp_extract_all(mask, F.lit(rf"(?md)^[ \t]*+{word}[ \t]++({py.NAME})"), F.lit(1))

    return staged.select(
        "project", "path", "language", "total_lines", "code_lines", "blank_lines",
        "max_line_length", "avg_line_length",
        F.when(is_text, F.lit(0.0)).when(is_python, py.file_complexity(mask))
        .otherwise(text.keyword_complexity(content)).alias("complexity"),
        F.when(is_text, none).when(is_python, heads("def"))
        .otherwise(text.function_names(content)).alias("functions"),
        F.when(is_text, none).when(is_python, heads("class"))
        .otherwise(text.class_names(content)).alias("classes"),
    )


def project_totals(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("project").agg(
        F.count("*").alias("total_files"),
        F.sum("code_lines").alias("total_lines"),
        F.sum(F.size("functions")).alias("total_functions"),
        F.sum(F.size("classes")).alias("total_classes"),
    )


def script_line_counts(files: DataFrame) -> DataFrame:
    """Line counts where `#` lines are no code and every line end counts."""
    split = files.select("project", "path", text.split_lines(F.col("content")).alias("lines"))
    blank = F.size(F.filter("lines", lambda line: text.is_blank(line)))
    code = F.size(F.filter("lines", lambda line: text.normalised_line(line) != ""))
    return split.select(
        "project", "path", F.size("lines").alias("total_lines"),
        blank.alias("blank_lines"), code.alias("code_lines"),
    )


def project_sizes(files: DataFrame) -> DataFrame:
    """Bytes per project with result lifetime and the too-big-for-one-task flag."""
    dotted = files.filter(F.contains(paths.basename(F.col("path")), F.lit(".")))
    sized = dotted.groupBy("project").agg(F.sum("size").alias("bytes"))
    return sized.select(
        "project", "bytes",
        keys.ttl_seconds(F.col("bytes")).alias("ttl_seconds"),
        keys.needs_partitioning(F.col("bytes")).alias("needs_partitioning"),
    )


def dependencies(manifests: DataFrame) -> DataFrame:
    """Declared dependencies: requirement lines, and names of a package file."""
    name = paths.basename(F.col("path"))
    content = F.col("content")
    lines = F.filter(
        F.transform(text.lines_of(content), lambda line: text.normalised_line(line)), lambda d: d != ""
    )
    package = F.map_keys(F.from_json(F.get_json_object(content, "$.dependencies"), "map<string,string>"))
    listed = manifests.select(
        "project",
        F.when(name == "requirements.txt", F.lit("Python")).when(name == "package.json", F.lit("JavaScript"))
        .alias("language"),
        F.explode(F.when(name == "requirements.txt", lines).when(name == "package.json", package))
        .alias("dependency"),
    )
    return listed
