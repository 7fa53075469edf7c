"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import materialize, release


def _toward_least(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) links with u > v."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that a link names; component is the smallest node reachable.

    links: pairs of longs in columns a and b, in any order, repeated or not; loops and nulls are ignored.
    Each round is two shuffles over the links, which shrink to one star per component; rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder, so a lost executor repeats
    one round at most. No links: no rows.
    """
    now = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
        .filter("x and y and u > v")
        .select(F.col("u").cast("long"), F.col("v").cast("long"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        later = materialize(_toward_least(_toward_least(now, True), False))
        seen = later.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        now = later
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
