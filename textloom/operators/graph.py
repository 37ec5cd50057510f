"""Graphs as edge tables (src, dst, len)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.tables import discard, materialize


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each pair of ends, with the least length; loops go."""
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "len")
    return ends.groupBy("src", "dst").agg(F.min("len").alias("len"))


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")


def subgraph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges whose ends are both listed."""
    v = vertices.select("v").distinct()
    return edges.join(v.withColumnRenamed("v", "src"), "src", "left_semi").join(v.withColumnRenamed("v", "dst"), "dst", "left_semi")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest, by Boruvka rounds; equal lengths are ordered by their ends.

    Each round takes every component's shortest way out and relabels components by
    pointer jumping; the number of components at least halves, so rounds are few. All
    steps are joins and aggregates, materialised once a round.
    """
    live = materialize(undirected(edges).select("src", "dst", "len", F.col("src").alias("ca"), F.col("dst").alias("cb")), "graph")
    spark, shape = edges.sparkSession, "src {0}, dst {0}, len {1}".format(edges.schema["src"].dataType.simpleString(), edges.schema["len"].dataType.simpleString())
    forest = spark.createDataFrame([], shape)
    while not live.isEmpty():
        edge = F.struct("len", "src", "dst")
        ways = live.select(F.col("ca").alias("c"), F.col("cb").alias("to"), edge.alias("e")).unionByName(live.select(F.col("cb").alias("c"), F.col("ca").alias("to"), edge.alias("e")))
        best = ways.groupBy("c").agg(F.min_by(F.struct("to", "e"), "e").alias("way")).select("c", F.col("way.to").alias("to"), F.col("way.e").alias("e"))
        best = materialize(best, "ways")
        forest = materialize(forest.unionByName(best.select("e.src", "e.dst", "e.len").distinct()), "forest")
        # Of two components that choose each other the smaller is the root.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        up = materialize(up, "parents")
        while True:
            next_up = materialize(
                up.join(up.select(F.col("c").alias("up"), F.col("up").alias("top")), "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents"
            )
            moved = next_up.filter("moved").isEmpty()
            up = next_up.select("c", "up")
            if moved:
                break
        names = lambda side: up.select(F.col("c").alias(side), F.col("up").alias(f"n{side}"))
        live = live.join(names("ca"), "ca").join(names("cb"), "cb").filter("nca <> ncb")
        live = materialize(live.select("src", "dst", "len", F.col("nca").alias("ca"), F.col("ncb").alias("cb")), "graph")
    return forest


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of an edge table (a, b): component is the least node that can be reached.

    Every round ties each node's larger neighbours, and then its smaller ones, to the least
    node around, so a path of n nodes takes about log n rounds and no node ever collects its
    neighbours. Only the last round's table stays.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "ties")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        wide = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        wide = materialize(wide, "ties")
        low = wide.groupBy("a").agg(F.min("b").alias("low"))
        near = wide.join(low, "a").filter("b <> low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        last, edges = edges, materialize(near.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "ties")
        discard(last)
        discard(wide)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def matrix_cells(cells: DataFrame, kind: str = "full", width: int = 0) -> DataFrame:
    """The stored cells (row, col, val) of a matrix: full, upper, lower, symmetric (keys ordered), diagonal or banded."""
    tests = {
        "full": F.lit(True),
        "upper": F.col("row") <= F.col("col"),
        "lower": F.col("row") >= F.col("col"),
        "diagonal": F.col("row") == F.col("col"),
        "banded": F.abs(F.col("row") - F.col("col")) <= width,
    }
    if kind == "symmetric":
        # Where both halves are stored the upper one counts.
        ends = cells.groupBy(F.least("row", "col").alias("r"), F.greatest("row", "col").alias("c")).agg(F.min_by("val", F.col("row") > F.col("col")).alias("val"))
        return ends.select(F.col("r").alias("row"), F.col("c").alias("col"), "val")
    return cells.filter(tests[kind])


def matrix_elements(cells: DataFrame, wanted: DataFrame, kind: str = "full", width: int = 0) -> DataFrame:
    """(row, col, val) of the wanted elements (row, col) of a matrix; what it does not store is 0, a symmetric one has both halves."""
    held = matrix_cells(cells, kind, width).select(F.col("row").alias("r"), F.col("col").alias("c"), "val")
    row, col = (F.least("row", "col"), F.greatest("row", "col")) if kind == "symmetric" else (F.col("row"), F.col("col"))
    keyed = wanted.select("row", "col", row.alias("r"), col.alias("c"))
    return keyed.join(held, ["r", "c"], "left").select("row", "col", F.coalesce("val", F.lit(0.0)).alias("val"))
