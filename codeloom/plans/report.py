"""The project report and the result documents, as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.operators import files as file_ops


# The headings and labels in the functions below are the words of
# the report and must stay as they are.


def _text(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def _array(*columns: Column) -> Column:
    return F.array(*[F.lit(c) if isinstance(c, str) else c for c in columns])


def report_lines(analyses: DataFrame, summaries: DataFrame | None = None,
                 suggestions: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Report of every project: project, section, path, seq, line.

    Sorted by those columns the lines are the Markdown text. Sections are 1
    overview, 2 languages, 3 files. `summaries` (project, path, summary) and
    `suggestions` (project, path, place, line, message, suggested_code, explanation),
    listed by place, are optional. `compat` repeats an old slip: total lines show the code lines
    and blank lines show 0.
    """
    totals = file_ops.project_totals(analyses)
    overview = totals.select(
        "project", F.lit(1).alias("section"), F.lit("").alias("path"),
        F.posexplode(_array(
            "# Relatório de Análise do Projeto", "", "## Visão Geral",
            _text("- Total de arquivos: ", F.col("total_files")),
            _text("- Total de linhas: ", F.col("total_lines")),
            _text("- Total de funções: ", F.col("total_functions")),
            _text("- Total de classes: ", F.col("total_classes")),
            "", "## Linguagens Utilizadas",
        )).alias("seq", "line"),
    )
    counts = analyses.groupBy("project", "language").agg(F.count("*").alias("n"))
    languages = counts.select(
        "project", F.lit(2).alias("section"), F.col("language").alias("path"), F.lit(0).alias("seq"),
        F.concat(F.lit("- "), F.col("language"), F.lit(": "), F.col("n").cast("string"), F.lit(" arquivo(s)"))
        .alias("line"),
    )
    heading = totals.select(
        "project", F.lit(3).alias("section"), F.lit("").alias("path"),
        F.posexplode(_array("", "## Análises de Arquivos", "")).alias("seq", "line"),
    )
    total = F.col("code_lines") if compat else F.col("total_lines")
    blank = F.lit(0) if compat else F.col("blank_lines")
    is_code = ~paths.is_text_language(F.col("language"))
    block = F.concat(
        _array(
            F.concat(F.lit("### "), F.col("path")),
            _text("- Linguagem: ", F.col("language")),
            _text("- Linhas totais: ", total),
            _text("- Linhas em branco: ", blank),
            _text("- Linhas de conteúdo: ", F.col("code_lines")),
            _text("- Tamanho máximo de linha: ", F.col("max_line_length")),
            F.concat(F.lit("- Tamanho médio de linha: "), text.one_decimal(F.col("avg_line_length"))),
        ),
        F.when(is_code, F.array(
            F.concat(F.lit("- Complexidade: "), text.one_decimal(F.col("complexity")))
        )).otherwise(F.array().cast("array<string>")),
    )
    body = analyses.select(
        "project", F.lit(3).alias("section"), "path", F.posexplode(block).alias("seq", "line")
    )
    parts = [overview, languages, heading, body]
    located = analyses.select("project", "path")
    if summaries is not None:
        parts.append(located.join(summaries, ["project", "path"]).select(
            "project", F.lit(3).alias("section"), "path",
            F.posexplode(_array("", "#### Resumo do Arquivo", F.col("summary"))).alias("seq", "line"),
        ).withColumn("seq", F.col("seq") + 100))
    if suggestions is not None:
        given = located.join(suggestions, ["project", "path"])
        parts.append(given.select("project", "path").distinct().select(
            "project", F.lit(3).alias("section"), "path",
            F.posexplode(_array("", "#### Sugestões de Melhoria")).alias("seq", "line"),
        ).withColumn("seq", F.col("seq") + 200))
        entry = F.filter(F.array(
            F.concat(F.lit("- Linha "), F.col("line").cast("string"), F.lit(": "), F.col("message")),
            F.when(F.col("suggested_code") != "", F.concat(F.lit("  Sugestão: "), F.col("suggested_code"))),
            F.when(F.col("explanation") != "", F.concat(F.lit("  Explicação: "), F.col("explanation"))),
        ), lambda line: line.isNotNull())
        rows = given.select(
            "project", F.lit(3).alias("section"), "path", "place", F.posexplode(entry).alias("k", "text")
        )
        parts.append(rows.select(
            "project", "section", "path",
            (F.lit(1000) + F.col("place") * 10 + F.col("k")).alias("seq"), F.col("text").alias("line"),
        ))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.withColumn("seq", F.col("seq").cast("long"))


def project_documents(metrics: DataFrame, smells: DataFrame) -> DataFrame:
    """Result documents: one JSON row of metrics per project, one per smell.

    A list of all smells inside one document would grow without bound with
    the project, so each smell is a document of its own.
    """
    head = metrics.select(
        "project", F.lit("metrics").alias("kind"),
        F.to_json(F.struct(
            "total_lines", "total_functions", "total_classes", "code_lines", "blank_lines",
            F.col("density").alias("complexity"),
        )).alias("json"),
    )
    rows = smells.select(
        "project", F.lit("smell").alias("kind"),
        F.to_json(F.struct(
            "type", F.col("path").alias("file"), "line", "message", "severity", "suggestion"
        )).alias("json"),
    )
    return head.unionByName(rows)
