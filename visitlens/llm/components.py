"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, write_table


def _star(links: DataFrame, *, large: bool) -> DataFrame:
    """One step over (a, b) with a > b: every neighbour of a node is linked to the least of them. ``links`` is used up."""
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = write_table(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-least")
    moved = near.where("b > a") if large else near
    linked = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    found = write_table(linked.where("a > b").distinct(), "star-links")
    discard(links, least)
    return found


def connected_components(links: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its least node.

    Rows that link a node with itself, repeated rows and either order of a pair are allowed; nulls are not. Each round
    keeps the number of links at most the same and ends when nothing changes; a hub is dealt with by its partial minimum
    and by joins of two shuffled sides, which Spark can split.
    """
    one_way = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = write_table(one_way, "links"), None
    for _ in range(most_rounds):
        now = _star(_star(now, large=True), large=False)
        was, mark = mark, now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"links were still changing after {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
