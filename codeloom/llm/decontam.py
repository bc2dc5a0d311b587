"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity of whole sets says
nothing; what counts is the share of an item's shingles that a document holds.
Items are partitioned by size. In a partition each item is indexed by a sketch,
the least hashed of its shingles, as many as a document that holds the required
share cannot miss altogether. Documents are streamed past the sketches, and
whatever meets one is verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.sizes import join_checked, small_enough
from codeloom.session import cut_lineage

WIDTH = 5
SHARE_PERCENT = 75


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def windows(df: DataFrame, id_column: str, width: int) -> DataFrame:
    """One row per shingle: the id, its words and the place of its first word (from 1).

    The words stay one array per text, which every row of the text refers to.
    """
    cut = df.select(id_column, words(F.col("text")).alias("words")).where(F.size("words") >= width)
    return cut.select(id_column, "words", F.explode(F.sequence(F.lit(1), F.size("words") - (width - 1))).alias("at"))


def place(offset: int) -> Column:
    return F.element_at("words", F.col("at") + offset)


def hashed(width: int) -> Column:
    return F.xxhash64(*[place(k) for k in range(width)])


def spelled(width: int) -> Column:
    return F.concat_ws(" ", *[place(k) for k in range(width)])


def required(n: Column, percent: int) -> Column:
    """The least whole number that is `percent` per cent of `n` or more."""
    return F.ceil(n * percent / F.lit(100.0)).cast("int")


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """Distinct shingles of each item with their number: item_id, shingle, h, n."""
    one = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    distinct = windows(one, "item_id", width).select(
        "item_id", spelled(width).alias("shingle"), hashed(width).alias("h")).distinct()
    return distinct.join(distinct.groupBy("item_id").agg(F.count("*").cast("int").alias("n")), "item_id")


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """The sketch of each item: item_id, h.

    A partition holds the items with n in (2^(p-1), 2^p]. Of n shingles a match
    misses at most n - required(n), so one more than the partition's largest
    such number is enough for all its items; the least by a second hash are kept.
    """
    part = F.ceil(F.log2("n"))
    slack = F.col("n") - required(F.col("n"), percent) + 1
    lengths = shingles.groupBy(part.alias("part")).agg(F.max(slack).alias("length"))
    per_item = shingles.groupBy("item_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64("h", F.lit(1)).alias("m"), "h"))).alias("all"))
    return per_item.join(lengths, "part").select(
        "item_id", F.explode(F.slice("all", F.lit(1), F.col("length"))).alias("x")).select("item_id", "x.h")


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = SHARE_PERCENT) -> DataFrame:
    """Pairs of a document and an item of which it holds at least `percent` per cent of the shingles.

    Result: doc_id, item_id, n_item (distinct shingles of the item), n_shared,
    containment. Shingles are `width` words, words are runs of letters and
    digits in lower case. Null or empty texts, and items or documents of fewer
    than `width` words, have no shingle and match nothing. Rows sharing an id
    count as one text; rows without an id are not reported. Empty tables give an
    empty result; other columns are ignored.

    No pair is lost: a match must hold a shingle of the item's sketch. Nothing
    but hits is shuffled; items are sent to the executors only if few enough.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shingles = cut_lineage(item_shingles(items, width), "items")
    sketch = cut_lineage(sketches(shingles, percent), "sketches")
    streamed = windows(known, "doc_id", width).select("doc_id", hashed(width).alias("h"))
    met = cut_lineage(join_checked(streamed, sketch, "h", "inner").select("doc_id", "item_id").distinct(), "candidates")
    ids = cut_lineage(met.select("doc_id").distinct(), "candidate_ids")
    again = windows(join_checked(known, ids, "doc_id", "left_semi"), "doc_id", width)
    spoken = again.select("doc_id", spelled(width).alias("shingle"))
    shared = (join_checked(spoken, shingles.select("item_id", "shingle", "n"), "shingle", "inner")
              .select("doc_id", "item_id", "shingle", "n").distinct()
              .groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared")))
    held = shared.where(F.col("n_shared") * 100 >= F.col("n") * percent)
    return held.join(met, ["doc_id", "item_id"], "left_semi").select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = SHARE_PERCENT) -> DataFrame:
    """`docs` without the documents that hold an item, all columns kept; rows without an id stay."""
    held = cut_lineage(contaminated(docs, items, width, percent).select(F.col("doc_id").alias("_held")).distinct(),
                       "contaminated")
    side = F.broadcast(held) if small_enough(held) else held
    return docs.join(side, docs["doc_id"].cast("long") == side["_held"], "left_anti")


SQL = r"""
WITH cut_docs AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
cut_items AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut_items)),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut_docs)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (shingle)
  GROUP BY doc_id, item_id)
SELECT doc_id, s.item_id, n AS n_item, n_shared, n_shared / n AS containment
FROM shared s JOIN sizes z ON z.item_id = s.item_id WHERE 100 * n_shared >= 75 * n
"""
