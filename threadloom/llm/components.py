"""Connected components by alternating large and small stars, on DataFrames alone.

Each step moves edges towards the least node of a neighbourhood (Kiveris et al., 2014); the
edges left at the end join each node to the least node of its component.  Every round is
written to the shared folder, so lineage stays short and nothing is gathered on the driver
but whether all edges are such stars already.  Edges may repeat: only what a round writes is made
distinct, since every step before gives at most one row for each edge it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.workspace import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u, to the least of u and its neighbours; as many rows as edges."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(edges: DataFrame) -> DataFrame:
    """u (the larger of each edge) and its smaller neighbours, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    of = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return of.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every v is the least of its component."""
    roles = edges.select("u", F.lit(1).alias("as_u")).union(edges.select("v", F.lit(0)))
    each = roles.groupBy("u").agg(F.sum("as_u").alias("times"), F.min("as_u").alias("root"))
    return not each.where("times > 1 or times = 1 and root = 0").limit(1).collect()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the component's least node."""
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while True:
        edges = materialize(_small(_large(edges)), "edges")
        if _are_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
