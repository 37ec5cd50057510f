"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.operators.tables import discard


def large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node that can be reached; only nodes with edges are listed.

    edges: columns a and b of one ordered type, no nulls; loops and repeated edges are
    allowed. Each round's edges are written to the shared folder. The hub of a large
    component meets its neighbours in joins and partial aggregates only, never in a
    window or a list.
    """
    loops = edges.filter("a = b").select("a").distinct()
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        last, edges = edges, materialize(small_star(large_star(edges)), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    hubs = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    both = found.unionByName(hubs)
    alone = loops.select(F.col("a").alias("node")).join(both, "node", "left_anti")
    return both.unionByName(alone.withColumn("component", F.col("node")))
