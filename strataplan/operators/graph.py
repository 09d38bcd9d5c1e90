"""Connected components of a distributed edge list: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplan.runtime import SHORT_ROWS, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 50, at_most: int | None = None) -> DataFrame:
    """node, root (the smallest node of its component), for every node of an edge (u, v) list.

    Each round is written to the shared folder, so a lost executor costs one round at most. It is over when every node
    but the roots hangs on exactly one that hangs on none, which edges that are stars already need no round for. Rounds
    grow with the logarithm of the number of nodes; ``rounds`` only stops a run that would never end, by raising.
    ``at_most``: edges at most, where the caller knows.
    """
    down = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = save(down.distinct(), "edges", at_most)
    n, moving = _state(edges)
    for _ in range(rounds):
        if not moving:
            break
        edges = save(_small_star(_large_star(edges)).distinct(), "edges", n, SHORT_ROWS if n > SHORT_ROWS else 0)
        n, moving = _state(edges)
    else:
        if moving:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges (u, v; v < u), and of nodes that hang on several or on a node that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    at = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, moving = at.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n, moving


def merged_components(roots: DataFrame, links: DataFrame, at_most: int | None = None) -> DataFrame:
    """``roots`` (node, root) after more links (u, v): only the links' own components are searched again, root by root."""
    u, v = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "uv")
    between = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    found = components(between, at_most=at_most)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    fresh = found.join(roots.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("_to", "root").alias("root")).unionByName(fresh.select("node", "root"))
