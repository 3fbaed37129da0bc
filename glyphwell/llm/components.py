"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphwell.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a vertex on the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a vertex and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``u``, ``v``: every vertex but the least of its component, with that least one.

    ``edges`` has columns ``u`` and ``v`` of one orderable type, without nulls;
    loops and repeats are allowed. Rounds grow with the logarithm of the largest
    component. Each ends in the shared folder, so a lost executor costs one round.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after = cut(_small_star(_large_star(now)))
        # Stars: each vertex hangs on one centre, and no centre hangs on another.
        state = after.groupBy("u").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        now = after
        if state == 1 and not chained:
            return now
