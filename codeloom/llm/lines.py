"""Boilerplate lines by their frequency relative to the site.

A line that stands on a large share of a host's pages is furniture of that site,
however rare it is elsewhere. Pages containing each line are counted per host
and divided by the host's pages; lines above the ratio go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.sizes import small_enough
from codeloom.llm.text import packed_row
from codeloom.session import cut_lineage

BLANKS = " \t\r\x0b\x0c"
BROADCAST_LINES = 500_000  # digests of 16 bytes
SALTS = 64


def digest(line: Column) -> Column:
    """128 bits that stand for a line without blanks at its ends."""
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANKS))))


def boilerplate(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """Digests of the boilerplate lines of each host, for pages (host, text).

    A page counts once for a line, however often it has it. A line goes if it is
    on at least `least_pages` pages of the host and on more than `ratio` of them.
    """
    named = pages.where(F.col("host").isNotNull())
    totals = named.groupBy("host").agg(F.count("*").alias("total"))
    lines = named.select("host", F.explode(F.array_distinct(
        F.transform(F.split("text", "\n"), digest))).alias("line")).where(F.col("line") != digest(F.lit("")))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return counted.join(totals, "host").where(F.col("n") > ratio * F.col("total")).select("host", "line")


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = 0.05, least_pages: int = 5) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`, plus `n_lines` and `n_dropped` in the last places.

    Lines end at line feeds and are compared without blanks at their ends; blank
    lines are never dropped and what stays keeps its order and its blanks. A
    null text stays null with 0 lines; a row without a host is not compared and
    stays as it is. Repeated rows count as pages of their own. Every row and
    every other column is kept; an empty table gives an empty result.

    A host has at most (lines per page) / `ratio` boilerplate lines, so its list
    is short however many pages it has. Lists are sent to all executors if there
    are few enough in all; otherwise they are joined, with salt for hosts that
    hold many rows.
    """
    pages = docs.select(packed_row(docs), F.col(f"`{host}`").alias("host"), F.col("text"))
    found = cut_lineage(boilerplate(pages.select("host", "text"), ratio, least_pages), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_list("line").alias("drops"))
    if small_enough(found, BROADCAST_LINES):
        joined = pages.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(
            salted, ["host", "salt"], "left")
    lines = F.split("text", "\n")
    stay = F.when(F.col("drops").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col("drops"), digest(x))))
    counted = joined.select("row", F.size(lines).alias("before"), stay.alias("stay"))
    text = F.when(F.col("stay").isNotNull(), F.array_join("stay", "\n"))
    new = {"n_lines": F.coalesce("before", F.lit(0)).cast("long"),
           "n_dropped": F.coalesce(F.col("before") - F.size("stay"), F.lit(0)).cast("long")}
    old = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in new]
    return counted.select(*old, *[value.alias(name) for name, value in new.items()])


SQL = r"""
WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
trimmed AS (
  SELECT doc_id, source, lines,
         list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) AS bare
  FROM cut),
seen AS (SELECT source, unnest(list_distinct(bare)) AS line FROM trimmed WHERE source IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source),
boiler AS (
  SELECT s.source, list(line) AS drops FROM (
    SELECT source, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY source, line) s
  JOIN totals t ON t.source = s.source
  WHERE n >= 5 AND n > 0.05 * total GROUP BY s.source)
SELECT d.doc_id,
       array_to_string(list_filter(d.lines, lambda x, i: NOT list_contains(coalesce(b.drops, []), d.bare[i])),
                       chr(10)) AS text,
       coalesce(len(d.lines), 0) AS n_lines,
       coalesce(len(list_filter(d.bare, lambda x: list_contains(coalesce(b.drops, []), x))), 0) AS n_dropped
FROM trimmed d LEFT JOIN boiler b ON b.source = d.source
"""
