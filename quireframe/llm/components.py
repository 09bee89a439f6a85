"""Connected components of an edge table by alternating star contractions, as plain aggregates and joins.

Each round replaces every edge by one to the smallest neighbour (larger side, then smaller side) until nothing changes,
which takes a logarithmic number of rounds.  Neighbours are never collected: the smallest of them is an aggregate with
partial sums, joined back to the edges, so a node with a third of all edges stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.tables import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node (u > v) and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the component is its smallest node."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        last, e = e, stored(_small(_large(e)), "stars")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
