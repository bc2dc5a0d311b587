"""Ranks and running sums over a whole table, without one task seeing it all.

A window without `partitionBy` would move every row to one task. Here rows are
range-partitioned by the order, ranked inside each range, and shifted by the
totals of the ranges before. Only those totals, one row per range, meet in one
place. The order must be total (end it with a unique column), then no key or
tie can make a range larger than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage


def ranked(df: DataFrame, order: list[Column], amount: str | None = None) -> DataFrame:
    """Add `rn` (1-based), `total_rows` and, given `amount`, `running` and `total_amount`.

    The range of a row is stored before it is used: a range partitioning that
    is computed twice may cut elsewhere the second time.
    """
    stored = cut_lineage(
        df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()), "ranges"
    )
    value = F.col(amount) if amount else F.lit(0).cast("long")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = stored.groupBy("range_id").agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    offsets = sums.select(
        "range_id",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("amount_before"),
        F.sum("n").over(whole).alias("total_rows"),
        F.sum("s").over(whole).alias("total_amount"),
    )
    inside = Window.partitionBy("range_id").orderBy(*order)
    local = stored.withColumn("local_rn", F.row_number().over(inside))
    if amount:
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = local.withColumn("local_sum", F.sum(amount).over(upto))
    joined = local.join(offsets, "range_id")
    result = joined.withColumn("rn", F.col("local_rn") + F.col("rows_before"))
    if amount:
        result = result.withColumn("running", F.col("local_sum") + F.col("amount_before"))
    dropped = ["range_id", "local_rn", "rows_before", "amount_before"]
    return result.drop(*dropped, *(["local_sum"] if amount else ["total_amount"]))


def dense_ranked(df: DataFrame, value: str, unique: str, name: str) -> DataFrame:
    """Add the dense rank of `value`, largest first, as `name`.

    Rows are cut into ranges by (value, unique), so rows of one value may fill
    several ranges. Each range counts its distinct values; a range that starts
    with the value the one before ended with shares that rank.
    """
    stored = cut_lineage(
        df.repartitionByRange(F.col(value).desc(), F.col(unique)).withColumn("range_id", F.spark_partition_id()),
        "dense_ranges",
    )
    ranges = stored.groupBy("range_id").agg(
        F.count_distinct(value).alias("n"), F.max(value).alias("top"), F.min(value).alias("low")
    )
    order = Window.orderBy("range_id")
    stepped = ranges.withColumn("shared", (F.col("top") == F.lag("low").over(order)).cast("long"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = F.coalesce(F.sum("shared").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    offsets = stepped.select("range_id", (before - shared).alias("offset"))
    inside = F.dense_rank().over(Window.partitionBy("range_id").orderBy(F.col(value).desc()))
    return (stored.withColumn("local_rank", inside).join(offsets, "range_id")
            .withColumn(name, (F.col("local_rank") + F.col("offset")).cast("long"))
            .drop("range_id", "local_rank", "offset"))
