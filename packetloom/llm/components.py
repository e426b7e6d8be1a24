"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import pinned


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node of the component, for every node of ``edges`` (a, b bigint).

    Large-star and small-star rounds: each node links its neighbours to the
    least node it knows, until only stars are left; the edge count never grows.
    A node with very many neighbours is only ever seen through aggregates and
    joins, so no neighbour list is gathered. Edges must not be null; loops and
    repeated edges are allowed; no edges give no rows.
    """
    edges = pinned(_canonical(edges.select("a", "b")))
    for _ in range(max_rounds):
        if _all_stars(edges):
            # Rounds keep what is connected, so every node still is an end of an edge.
            return _each(edges, ("a", "b"), ("b", "b")).select(F.col("x").alias("node"), F.col("y").alias("component")).distinct()
        edges = pinned(_small_star(_large_star(edges)))
    raise ValueError("components did not settle")


def _each(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (x, y), one per edge and pair of columns; unlike a union it reads the edges in one task per partition."""
    return edges.select(
        F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs))).alias("e")
    ).select("e.x", "e.y")


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return (
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none, or else larger ones only."""
    ends = _each(edges, ("a", "b"), ("b", "a"))
    nodes = ends.groupBy("x").agg(F.count_if(F.col("y") < F.col("x")).alias("smaller"), F.max("y").alias("most"))
    return nodes.filter((F.col("smaller") > 1) | (F.col("smaller") == 1) & (F.col("most") > F.col("x"))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least node around it; for canonical edges, at most as many rows."""
    least = _each(edges, ("a", "b"), ("b", "a")).groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
    upward = edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    return upward.join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _each(edges.join(least, "a"), ("a", "m"), ("b", "m"))
    return moved.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
