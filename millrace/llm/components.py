"""Connected components of a distributed edge list: large-star and small-star rounds.

Every step is a join or an aggregation over the edges; nothing is collected.
A node's least neighbour comes from an aggregation with map-side partials, and
is joined back as a settled table, so adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_files, settle


def _least(pairs: DataFrame, rows: int) -> DataFrame:
    """Of (u, v): each u's least node among itself and its v."""
    return settle(in_files(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), rows), "least")


def _are_stars(edges: DataFrame, rows: int) -> bool:
    """Whether every b has one a, and no a is a b: then each component is a star about its least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
    return in_files(counted.where("down > 1 or (down > 0 and up > 0)"), rows).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node reachable.

    Loops and repeated edges are allowed; edges with a null end are ignored; a
    node without an edge to another is not in the result. Nodes of any type
    with an order.
    """
    now = settle(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    rows = now.count()  # no step makes more edges
    while not _are_stars(now, rows):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _least(both, rows)
        # large star: neighbours greater than u go to u's least
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        large = settle(in_files(large, rows), "edges")
        discard(now, least)
        # small star: u and its smaller neighbours go to the least of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = _least(down, rows)
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        now = settle(in_files(moved.union(own).where("a != b").distinct(), rows), "edges")
        discard(large, least)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
