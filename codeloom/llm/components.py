"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """The least neighbour of each `u`."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbours(both)
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; edges run from larger to smaller."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = _least_neighbours(down)
    moved = down.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"),
                                                                             F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """For every node of `edges` (u, v) its component, the least node reachable: node, component.

    Direction, repeats and loops do not matter. Only nodes with an edge to
    another node appear. Each round is two joins on node ids; minima are
    aggregated before they are joined, and every round is stored, so a lost
    executor costs no more than the round. Rounds grow with the logarithm of the
    longest path.
    """
    stars = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct(), "edges")
    before = _print_of(stars)
    for _ in range(most_rounds):
        stars = cut_lineage(small_star(large_star(stars)), "stars")
        now = _print_of(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
