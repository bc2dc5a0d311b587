"""Multi-party dialogues, once from the view of every participant.

For each participant the dialogue is rendered with that speaker as the
assistant, the others as users with their names, system turns as they are, and
a mask that marks what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

SYSTEM = "system"
OPEN, CLOSE, TURN_END = "<|turn|>", "<|text|>", "<|end|>\n"


def header(role: Column, name: Column) -> Column:
    """What stands before the words of a turn; users carry their name."""
    named = F.concat(F.lit(" name="), name)
    return F.concat(F.lit(OPEN), role, F.when(role == "user", named).otherwise(F.lit("")), F.lit(CLOSE))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns in order, cut into ranges of like size: adds `range_id`.

    Ranges follow (conversation, turn, speaker, text), so a long conversation is
    spread over several and none has to fit into one task. The range of a row is
    stored before it is used.
    """
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("name"),
        F.coalesce("text", F.lit("")).alias("content"))
    ranged = clean.repartitionByRange("conv_id", "turn", "name", "content")
    return cut_lineage(ranged.withColumn("range_id", F.spark_partition_id()), "turns")


def perspectives(turns: DataFrame) -> DataFrame:
    """One row per conversation, participant and turn of `turns` (conv_id, turn, role, text).

    Result: conv_id, perspective, position (from 0), turn, role, name, segment
    (the rendered turn), start and end of the segment in the whole rendering,
    and mask_start and mask_end, the part of it to be learned: what the
    participant says with its end mark, null in all other turns. The rendering
    of a conversation is its segments in order of `position`; `rendered` joins
    them. Offsets are characters.

    Every speaker but `system` is a participant; a conversation of system turns
    alone has no row. A null role is a speaker `unknown`, a null text is empty, a
    null turn comes first; rows without a conversation are left out. Equal turn
    numbers are ordered by speaker, then text, so repeated rows follow each
    other. An empty table gives an empty result; other columns are ignored.
    """
    stored = ordered_turns(turns)
    people = (stored.where(F.col("name") != SYSTEM).groupBy("conv_id", "name").agg(F.lit(1).alias("_one"))
              .select("conv_id", F.col("name").alias("perspective")))
    role = (F.when(F.col("name") == SYSTEM, SYSTEM)
            .when(F.col("name") == F.col("perspective"), "assistant").otherwise("user"))
    # Joined by range: a conversation alone as the key would bring all of a long one into one task.
    viewed = stored.select("range_id", "conv_id").distinct().join(people, "conv_id")
    seen = (stored.join(viewed, ["range_id", "conv_id"]).withColumn("role", role)
            .withColumn("head", header(F.col("role"), F.col("name")))
            .withColumn("segment", F.concat("head", "content", F.lit(TURN_END)))
            .withColumn("size", F.length("segment").cast("long")))
    order = [F.col("turn").asc_nulls_first(), F.col("name"), F.col("content")]
    inside = Window.partitionBy("range_id", "conv_id", "perspective").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (seen.withColumn("n", F.row_number().over(inside).cast("long"))
             .withColumn("upto", F.sum("size").over(upto)))
    # Sums per range, then running sums over the ranges of a conversation: few rows.
    before = Window.partitionBy("conv_id", "perspective").orderBy("range_id").rowsBetween(
        Window.unboundedPreceding, -1)
    speakers = (stored.withColumn("bare", (F.length("content") + len(TURN_END)).cast("long"))
                .groupBy("range_id", "conv_id", "name")
                .agg(F.count("*").alias("rows"), F.sum("bare").alias("bare")))
    sums = (speakers.join(people, "conv_id").withColumn("role", role)
            .withColumn("chars", F.col("bare") + F.col("rows") * F.length(header(F.col("role"), F.col("name"))))
            .groupBy("range_id", "conv_id", "perspective")
            .agg(F.sum("rows").alias("rows"), F.sum("chars").alias("chars")))
    zero = F.lit(0).cast("long")
    offsets = sums.select("range_id", "conv_id", "perspective",
                          F.coalesce(F.sum("rows").over(before), zero).alias("rows_before"),
                          F.coalesce(F.sum("chars").over(before), zero).alias("chars_before"))
    end = F.col("upto") + F.col("chars_before")
    speaks = F.col("role") == "assistant"
    return local.join(offsets, ["range_id", "conv_id", "perspective"]).select(
        "conv_id", "perspective", (F.col("n") + F.col("rows_before") - 1).alias("position"), "turn", "role", "name",
        "segment", (end - F.col("size")).alias("start"), end.alias("end"),
        F.when(speaks, end - F.col("size") + F.length("head")).alias("mask_start"),
        F.when(speaks, end - 1).alias("mask_end"))


def rendered(views: DataFrame, most_turns: int = 10_000) -> DataFrame:
    """One row per conversation and participant: conv_id, perspective, part, text, mask.

    `mask` lists the learned spans within `text`. A rendering of more than
    `most_turns` turns comes in several parts, so that no row grows without
    bound; parts follow each other.
    """
    part = F.floor(F.col("position") / most_turns).alias("part")
    turn = F.struct("position", "segment", "start", "mask_start", "mask_end")
    grouped = views.groupBy("conv_id", "perspective", part).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.element_at("turns", 1)["start"]
    spans = F.transform(F.filter("turns", lambda t: t["mask_start"].isNotNull()),
                        lambda t: F.struct((t["mask_start"] - first).alias("start"), (t["mask_end"] - first).alias("end")))
    return grouped.select("conv_id", "perspective", "part", F.concat_ws("", F.col("turns.segment")).alias("text"),
                          spans.alias("mask"))


SQL = r"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS content
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, name AS perspective FROM clean WHERE name <> 'system'),
seen AS (
  SELECT c.*, perspective,
         CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM clean c JOIN people p ON p.conv_id = c.conv_id),
headed AS (
  SELECT *, '<|turn|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || '<|text|>' AS head
  FROM seen),
cut AS (SELECT *, head || content || '<|end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w AS upto FROM cut
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, content
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, name, segment,
       CAST(upto - length(segment) AS BIGINT) AS start, CAST(upto AS BIGINT) AS "end",
       CASE WHEN role = 'assistant' THEN CAST(upto - length(segment) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role = 'assistant' THEN CAST(upto - 1 AS BIGINT) END AS mask_end
FROM placed
"""
