"""Line and entity tables of a code corpus.

Everything here is a projection of the files table: a file is one row of at
most 5 MiB, its entities are exploded from that row, and no shuffle happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import python_source as py
from codeloom.functions import text


def line_table(files: DataFrame) -> DataFrame:
    """One row per line: number, indentation width, text."""
    exploded = files.select("project", "path", F.posexplode(text.lines_of(F.col("content"))).alias("pos", "text"))
    return exploded.select(
        "project",
        "path",
        (F.col("pos") + 1).alias("line_no"),
        F.length(F.regexp_extract("text", r"^([ \t]*)", 1)).alias("indent"),
        "text",
    )


def entity_blocks(files: DataFrame) -> DataFrame:
    """One row per def or class of a Python file, with the text of its block.

    A file Python does not accept has none. That test is a column, not a
    filter: a filter would be pushed below whatever computes the content and
    compute it twice.
    """
    masked = files.filter(F.col("ext") == ".py").select(
        "project", "path", py.scanned(files).alias("scan")).select("project", "path", "scan.*")
    heads, blocks = py.head_lines(F.col("mask")), py.blocks(F.col("mask"))
    paired = F.arrays_zip(heads.alias("line"), blocks.alias("block"))
    exploded = masked.select("project", "path", F.explode(F.when(F.col("parsed"), paired)).alias("e"))
    return exploded.select("project", "path", F.col("e.line").alias("start_line"), F.col("e.block").alias("block"))


def code_entities(files: DataFrame) -> DataFrame:
    """Functions and classes with their span and what the smell rules ask for."""
    block = F.col("block")
    is_function = F.col("kind") == "function"
    named = entity_blocks(files).withColumns(
        {"kind": py.block_kind(block), "indent": py.child_indent(block)}
    )
    in_class = named.withColumn(
        "statements", F.when(~is_function, py.direct_statements(block, F.col("indent")))
    )
    return in_class.select(
        "project",
        "path",
        "kind",
        py.block_name(block).alias("name"),
        "start_line",
        (F.col("start_line") + py.block_height(block)).alias("end_line"),
        py.is_async(block).alias("is_async"),
        F.when(is_function, py.parameter_count(block)).alias("params"),
        F.when(is_function, py.function_complexity(block)).alias("complexity"),
        F.when(~is_function, py.method_names(F.col("statements"))).alias("methods"),
        F.when(~is_function, py.assignment_targets(F.col("statements"))).alias("attributes"),
    )


def class_members(entities: DataFrame) -> DataFrame:
    """Direct methods, public ones among them, and direct attributes per class."""
    public = F.filter("methods", lambda m: ~m.startswith("__"))
    return entities.filter(F.col("kind") == "class").select(
        "project",
        "path",
        "name",
        "start_line",
        F.size("methods").alias("n_methods"),
        F.size(public).alias("n_public_methods"),
        F.col("attributes").alias("n_attributes"),
        F.array_join("methods", ",").alias("methods"),
    )


def python_complexity(files: DataFrame) -> DataFrame:
    """Per-file complexity of the Python files, by keywords where Python rejects one."""
    content = F.col("content")
    judged = files.filter(F.col("ext") == ".py").withColumn("scan", py.scanned(files))
    complexity = F.when(F.col("scan.parsed"), py.file_complexity(F.col("scan.mask")))
    return judged.select("project", "path", F.coalesce(complexity, text.keyword_complexity(content)).alias("complexity"))
