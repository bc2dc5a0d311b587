"""Code smells: rules over the entity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.files import script_line_counts
from codeloom.settings import GOD_CLASS_ATTRIBUTES, GOD_CLASS_METHODS, SMELL_TEXTS, Thresholds

SMELL_COLUMNS = ["project", "path", "line", "type", "severity", "message", "suggestion"]


def smell_struct(kind: str, *numbers: Column) -> Column:
    message, severity, suggestion = SMELL_TEXTS[kind]
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        (F.format_string(message, *numbers) if numbers else F.lit(message)).alias("message"),
        F.lit(suggestion).alias("suggestion"),
    )


def entity_smells(entities: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """All rules on functions and classes in one pass: no union, no join."""
    function = F.col("kind") == "function"
    height = F.col("end_line") - F.col("start_line")
    public = F.filter("methods", lambda m: ~m.startswith("__"))
    god = (F.size("methods") > GOD_CLASS_METHODS) | (F.col("attributes") > GOD_CLASS_ATTRIBUTES)
    rules = [
        (function & (height > limits.max_method_lines), smell_struct("long_method", height)),
        (function & (F.col("params") > limits.max_parameters),
         smell_struct("long_parameter_list", F.col("params"))),
        (function & (F.col("complexity") > limits.max_complexity),
         smell_struct("high_complexity", F.col("complexity"))),
        (~function & (height > limits.max_class_lines), smell_struct("large_class", height)),
        (~function & (F.size(public) == 0), smell_struct("data_class")),
        (~function & god, smell_struct("god_class")),
    ]
    hits = F.filter(F.array(*[F.when(test, smell) for test, smell in rules]), lambda s: s.isNotNull())
    found = entities.select("project", "path", F.col("start_line").alias("line"), F.explode(hits).alias("s"))
    return found.select("project", "path", "line", "s.type", "s.severity", "s.message", "s.suggestion")


def all_smells(entity_rows: DataFrame, duplicate_rows: DataFrame) -> DataFrame:
    return entity_rows.select(SMELL_COLUMNS).unionByName(duplicate_rows.select(SMELL_COLUMNS))


def project_metrics(files: DataFrame, entities: DataFrame, smells: DataFrame) -> DataFrame:
    """Per-project totals of the Python files with smell density (severity per code line).

    The three inputs are brought to one shape and summed once, so a project
    that holds most of the corpus is pre-aggregated before the only shuffle.
    """
    zero = F.lit(0).cast("long")
    names = ["total_lines", "code_lines", "blank_lines", "total_functions", "total_classes", "severity"]

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("project", *[given.get(n, zero).cast("long").alias(n) for n in names])

    counted = script_line_counts(files.filter(F.col("ext") == ".py"))
    rows = (
        part(counted, **{n: F.col(n) for n in names[:3]})
        .unionByName(part(entities, total_functions=(F.col("kind") == "function").cast("long"),
                          total_classes=(F.col("kind") == "class").cast("long")))
        .unionByName(part(smells, severity=F.col("severity")))
    )
    summed = rows.groupBy("project").agg(*[F.sum(n).alias(n) for n in names])
    density = F.when(F.col("code_lines") > 0, F.col("severity") / F.col("code_lines")).otherwise(F.lit(0.0))
    return summed.withColumn("density", density)
