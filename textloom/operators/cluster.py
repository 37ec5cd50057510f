"""Clustering of vector tables (vec_id, v array<double>[, label]).

Assignments maximise a similarity; ties go to the smallest centre. Searches of all vectors
against a table of others (centres, queries, members of clusters) take the others in
blocks of at most ``MAX_CENTRE_CELLS`` numbers: each block goes to all tasks, the vectors
are read once a block and never move, and only each block's best results are merged. For
cosine a block is a matrix product in numpy; other measures are Spark expressions over the
block as one array. Searches for one nearest centre rule out whole groups of centres by the
angle to their pivot (``prune``), and so do searches within a cosine distance; those within
other distances meet in a grid of distances to pivots. A task holds tiles of ``TILE_CELLS``
similarities, however many rows a batch or a block has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import measures as M
from textloom.functions.vectors import normalize
from textloom.operators.graph import components, spanning_forest
from textloom.operators.prune import Centres
from textloom.operators.tables import dense_ids, discard, materialize

MAX_CENTRE_CELLS = 4_000_000
#: Similarities that a task holds at once, whatever the sizes of the block and of its own batches.
TILE_CELLS = 2_000_000


@dataclass(frozen=True)
class Options:
    method: str = "kmeans"
    measure: str = "cosine"
    k: int = 2
    threshold: float = 0.2
    iterations: int = 5
    centroid: str = "sum"  # or mean
    representative: str = "centroid"  # or medoid, newest, prototype
    epsilon: float = 0.5
    min_points: int = 4
    seed: int = 0
    init: str = "separated"  # or random


# Names and abbreviations that an option string may use.
METHODS = ("agglomerative", "brown", "dbscan", "growseed", "incremental", "kmeans", "kmedoids", "optics", "snn")


def parse_options(text: str, base: Options = Options()) -> Options:
    """ "k=5:measure=dice:+random" as options; names may be cut to a unique prefix.

    A flag sets init: +random, or -random for the separated start.
    """
    out, names = base, list(Options.__dataclass_fields__)
    for part in filter(None, text.split(":")):
        if m := re.fullmatch(r"([+\-!])(\w+)", part):
            if not "random".startswith(m[2].lower()):
                raise ValueError(f"unknown flag {part!r}")
            out = replace(out, init="random" if m[1] == "+" else "separated")
            continue
        name, eq, value = part.partition("=")
        hits = [n for n in names if n == name.lower()] or [n for n in names if n.startswith(name.lower())]
        if not eq or len(hits) != 1:
            raise ValueError(f"unknown or unclear option {part!r}")
        kind = type(getattr(base, hits[0]))
        out = replace(out, **{hits[0]: kind(value)})
    if out.method not in METHODS:
        found = [m for m in METHODS if m.startswith(out.method)]
        if len(found) != 1:
            raise ValueError(f"unknown method {out.method!r}")
        out = replace(out, method=found[0])
    M.find_measure(out.measure)
    return out


def parsed_options(texts: Column) -> Column:
    """Option strings as structs of all options; error tells why a string is refused, and the others are null then."""
    fields = {n: {str: "string", int: "int", float: "double"}[type(getattr(Options(), n))] for n in Options.__dataclass_fields__}

    @F.pandas_udf(", ".join(f"{n} {kind}" for n, kind in fields.items()) + ", error string")
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text in s:
            try:
                o = parse_options(text)
                rows.append([*(getattr(o, n) for n in fields), None])
            except ValueError as e:
                rows.append([*[None] * len(fields), str(e)])
        return pd.DataFrame(rows, columns=[*fields, "error"])

    return parse(texts)


def blocks(rows: DataFrame, key: str, cells: int | None = None):
    """The rows (key, v, ...) in blocks of about so many numbers each, one after the other, as written tables' parts."""
    rows = materialize(rows, "blocks")
    size = rows.agg(F.sum(F.size("v"))).first()[0] or 0
    n = max(1, -(-size // (cells or MAX_CENTRE_CELLS)))
    for b in range(n):
        yield rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) if n > 1 else rows


def in_turn(some: Iterator[DataFrame], search: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What a search finds for each block; of several blocks each one's result is written before the next is read, so the driver holds one."""
    out, ahead = [], next(some)
    for block in some:
        out.append(materialize(search(ahead), "found"))
        ahead = block
    out.append(search(ahead) if not out else materialize(search(ahead), "found"))
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles of one length."""
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _block(rows: DataFrame, *names: str) -> tuple:
    """A block's columns on the driver, in the order of the first: lists, and the vectors as a matrix."""
    got = rows.select(*names, "v").toArrow().sort_by(names[0])
    return *[got.column(c).to_pylist() for c in names], _matrix(got.column("v").combine_chunks())


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows as a written table in some parts for each core: a file of one row group would be one task's work."""
    return materialize(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key), "dealt")


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, vectors) of batches (name, v) in pieces that meet so many others within TILE_CELLS."""
    step = max(1, TILE_CELLS // max(1, width))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield np.array(part.column(0).to_pylist()), _matrix(part.column(1))


def _best_in_block(vectors: DataFrame, block: DataFrame, measure: str) -> DataFrame:
    """(vec_id, centre, sim): the most similar of the block for each vector; block (centre, v)."""
    if measure == "cosine":
        names, m = _block(block, "centre")
        held = block.sparkSession.sparkContext.broadcast((np.array(names), _unit(m)))  # MAX_CENTRE_CELLS numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = held.value
            centres = Centres(ids, m) if len(ids) else None
            for batch in batches:
                if batch.num_rows and centres:
                    x = _unit(_matrix(batch.column(1)))
                    at, _ = centres.nearest(x)
                    sims = np.einsum("ij,ij->i", x, m[at])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at]), pa.array(sims)], names=["vec_id", "centre", "sim"])

        kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *block.schema)}
        return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, centre {kinds['centre']}, sim double")
    # One row that holds the whole block, whose size is bounded.
    whole = block.agg(F.collect_list(F.struct("centre", F.col("v").alias("cv"))).alias("all"))
    scored = vectors.select("vec_id", "v").crossJoin(F.broadcast(whole)).select("vec_id", "v", F.explode("all").alias("c")).select("vec_id", "v", "c.centre", "c.cv")
    scored = scored.select("vec_id", "centre", M.similarity(measure, "v", "cv").alias("sim"))
    return scored.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("centre")).alias("turn"))).alias("best")).select("vec_id", (-F.col("best.turn")).alias("centre"), F.col("best.sim").alias("sim"))


def nearest(vectors: DataFrame, centres: DataFrame, measure: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(vec_id, centre, sim): each vector's best centre of centres (centre, cv), if it reaches the threshold."""
    found = in_turn(blocks(centres.select("centre", F.col("cv").alias("v")), "centre"), lambda b: _best_in_block(vectors, b, measure))
    out = found[0]
    if len(found) > 1:
        both = reduce(DataFrame.unionByName, found)
        best = both.groupBy("vec_id").agg(F.max(F.struct(F.round("sim", 12).alias("near"), (-F.col("centre")).alias("turn"), "sim")).alias("best"))
        out = best.select("vec_id", (-F.col("best.turn")).alias("centre"), F.col("best.sim").alias("sim"))
    return out if threshold is None else out.filter(F.col("sim") >= threshold)


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """(query, vec_id, sim, rank): of each query the k most similar other vectors; "product" is the inner product."""
    q = queries.select(F.col("vec_id").alias("query"), "v")
    vectors = dealt(vectors.select("vec_id", "v"), "vec_id")
    out = reduce(DataFrame.unionByName, in_turn(blocks(q, "query"), lambda b: _ranked_in_block(b, vectors, k, measure)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _ranked_in_block(block: DataFrame, vectors: DataFrame, k: int, measure: str) -> DataFrame:
    """(query, vec_id, sim) with the k best of each task, at least, for the block's queries (query, v)."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if measure not in ("cosine", "product"):
        whole = block.agg(F.collect_list(F.struct("query", F.col("v").alias("qv"))).alias("all"))
        pairs = vectors.select("vec_id", "v").crossJoin(F.broadcast(whole)).select("vec_id", "v", F.explode("all").alias("q")).select("vec_id", "v", "q.query", "q.qv")
        pairs = pairs.filter(F.col("vec_id") != F.col("query")).select("query", "vec_id", M.similarity(measure, "qv", "v").alias("sim"))
        # The k best of each part of the vectors before any row moves.
        part = Window.partitionBy("query", "part").orderBy(F.desc("sim"), "vec_id")
        ranked = pairs.withColumn("part", F.spark_partition_id()).withColumn("near", F.row_number().over(part))
        return ranked.filter(F.col("near") <= k).select("query", "vec_id", "sim")
    names, m = _block(block, "query")
    scaled = _unit if measure == "cosine" else lambda x: x
    held = block.sparkSession.sparkContext.broadcast((np.array(names), scaled(m)))  # MAX_CENTRE_CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = held.value
        best_sim, best_id = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for own, x in _tiles(batches, min(len(ids), QUERY_TILE)):
            x = scaled(x)
            for q in range(0, len(ids), QUERY_TILE):
                some = slice(q, q + QUERY_TILE)
                merge_best(best_sim[some], best_id[some], own, _unlike(m[some] @ x.T, ids[some], own))
        row, at = np.nonzero(np.isfinite(best_sim))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_id[row, at]), pa.array(best_sim[row, at])], names=["query", "vec_id", "sim"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"query {kind}, vec_id {kind}, sim double")


#: Queries that meet a piece of a batch at once.
QUERY_TILE = 2048


def _unlike(sims: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """sims (ids ascending x own) with -inf where a vector meets itself, in place."""
    low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    while (at := np.flatnonzero(low < high)).size:
        sims[low[at], at] = -np.inf
        low = low + 1
    return sims


def merge_best(best_sim: np.ndarray, best_id: np.ndarray, own: np.ndarray, sims: np.ndarray) -> None:
    """The best of each row so far (similarity descending, of equal ones the least id first) with those of a tile (rows x own), in place; similarities count to 12 digits."""
    k = best_sim.shape[1]
    # What cannot be among the best after rounding is never sorted.
    floor = best_sim[:, -1]
    if np.isneginf(floor).any() and sims.shape[1] > k:
        floor = np.maximum(floor, np.partition(sims, sims.shape[1] - k, axis=1)[:, -k])
    row, col = np.nonzero((sims >= floor[:, None] - 1e-12) & (sims > -np.inf))
    if not len(row):
        return
    rows = np.unique(row)
    every = np.concatenate([row, np.repeat(rows, k)])
    value = np.concatenate([np.round(sims[row, col], 12), best_sim[rows].ravel()])
    name = np.concatenate([own[col], best_id[rows].ravel()])
    order = np.lexsort((name, -value, every))
    # Each row has k entries or more, its best so far among them.
    begin = np.searchsorted(every[order], rows)
    take = order[begin[:, None] + np.arange(k)]
    best_sim[rows], best_id[rows] = value[take], name[take]


#: Pivots of the grid in which vectors within a distance meet.
PIVOTS = 2


def within(vectors: DataFrame, epsilon: float, measure: str = "cosine") -> DataFrame:
    """(vec_id, other, dist) of every two vectors at a distance of at most epsilon, in both orders.

    Cosine takes the vectors in blocks, whose groups are ruled out by the angle to their pivot
    where it is larger than the group's radius and the angle of epsilon together; what is left
    is matrix products. Euclidean and Manhattan distance obey the triangle inequality: the
    distances of two near vectors to a pivot differ by no more than their own distance. So
    vectors are put into a grid of their distances to pivots, in steps of that length, and
    each meets the cells around its own. For squared Euclidean the step is the root; other
    measures have one cell for all pairs and are meant for bounded tables.
    """
    if measure == "cosine":
        rows = dealt(vectors.select("vec_id", "v").filter("v IS NOT NULL"), "vec_id")
        return reduce(DataFrame.unionByName, in_turn(blocks(rows, "vec_id"), lambda b: _near_in_block(rows, b, epsilon)))
    metric = {"euclidean": "euclidean", "squared_euclidean": "euclidean", "manhattan": "manhattan"}.get(measure)
    step = epsilon**0.5 if measure == "squared_euclidean" else epsilon
    rows = vectors.select("vec_id", "v")
    cells = []
    if metric:
        step = max(step * (1 + 1e-9), 1e-6)
        for k, r in enumerate(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()):
            rows = rows.withColumn(f"pivot{k}", F.array(*[F.lit(float(x)) for x in r["v"]]))
            gap = M.distance(metric, "v", f"pivot{k}")
            rows = rows.withColumn(f"cell{k}", F.floor(gap / step)).drop(f"pivot{k}")
            cells.append(f"cell{k}")
    if not cells:
        rows, cells = rows.withColumn("cell0", F.lit(0).cast("bigint")), ["cell0"]
    around = rows.select(F.col("vec_id").alias("other"), F.col("v").alias("w"), *cells)
    for c in cells if metric else []:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    met = rows.join(around, cells).filter("vec_id <> other")
    return met.withColumn("dist", M.distance(measure, "v", "w")).filter(F.col("dist") <= epsilon).select("vec_id", "other", "dist")


def _near_in_block(vectors: DataFrame, block: DataFrame, epsilon: float) -> DataFrame:
    """(vec_id, other, dist) of the vectors and those of the block with larger ids at a cosine distance of at most epsilon, in both orders."""
    held = block.sparkSession.sparkContext.broadcast(_block(block, "vec_id"))  # MAX_CENTRE_CELLS numbers
    kind, step = vectors.schema["vec_id"].dataType.simpleString(), float(np.arccos(max(-1.0, 1 - epsilon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = held.value
        centres = Centres(np.array(names), _unit(m)) if len(names) else None
        groups = [(g, centres.ids[w], centres.m[w]) for g, w in enumerate(centres.members)] if centres else []
        for own, x in _tiles(batches, max([len(centres.pivots), *map(len, centres.members)]) if centres else 1):
            if not groups:
                continue
            x = _unit(x)
            # A little more for rounding, which arccos makes larger near 0; zero vectors are at a right angle to all, as their distance of 1 says.
            angle = np.arccos(np.clip(x @ centres.pivots.T, -1.0, 1.0)) - 1e-6
            for g, ids, part in groups:
                rows = np.flatnonzero(angle[:, g] - centres.radius[g] <= step)
                if not len(rows):
                    continue
                dist = 1 - x[rows] @ part.T
                row, at = np.nonzero(dist <= epsilon)
                a, b, gap = own[rows[row]], ids[at], dist[row, at]
                less = a < b
                a, b, gap = a[less], b[less], gap[less]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([gap, gap]))], names=["vec_id", "other", "dist"])

    return vectors.mapInArrow(run, f"vec_id {kind}, other {kind}, dist double")


def centroids(assigned: DataFrame, how: str = "sum", cluster: str = "cluster") -> DataFrame:
    """(cluster, size, v): the elementwise sum (or mean) of each cluster's vectors."""
    cells = assigned.select(cluster, F.posexplode("v").alias("dim", "x")).groupBy(cluster, "dim").agg((F.sum("x") if how == "sum" else F.avg("x")).alias("x"))
    arrays = cells.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("v"))
    return arrays.join(assigned.groupBy(cluster).agg(F.count("*").alias("size")), cluster).select(cluster, "size", "v")


def sparse_centroids(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, idx, val) from the sparse members (cluster, vec_id, idx, val)."""
    return cells.groupBy(cluster, "idx").agg(F.sum("val").alias("val"))


def medoids(assigned: DataFrame, measure: str = "cosine", how: str = "sum") -> DataFrame:
    """(cluster, vec_id): of each cluster the member that is most similar to its centroid."""
    centre = centroids(assigned, how).select("cluster", F.col("v").alias("cv"))
    scored = assigned.join(centre, "cluster").select("cluster", "vec_id", M.similarity(measure, "v", "cv").alias("sim"))
    best = scored.groupBy("cluster").agg(F.max(F.struct("sim", (-F.col("vec_id")).alias("turn"))).alias("best"))
    return best.select("cluster", (-F.col("best.turn")).alias("vec_id"))


def linkage(assigned: DataFrame, how: str, measure: str = "cosine", kind: str = "similarity") -> DataFrame:
    """(c1, c2, sim), c1 < c2: average, furthest or nearest similarity of the members of two clusters, or distance.

    The furthest similarity is the least, the furthest distance the largest. The mean cosine
    of two clusters is the product of their sums of unit vectors over their sizes: two
    aggregates. Nearest and furthest need all pairs and take the members in blocks.
    """
    agg = {"average": "avg", "furthest": "min" if kind == "similarity" else "max", "nearest": "max" if kind == "similarity" else "min"}[how]
    name = "sim" if kind == "similarity" else "dist"
    if measure == "cosine" and how == "average":
        unit = assigned.select("cluster", normalize(F.col("v")).alias("v"))
        sums = materialize(centroids(unit), "sums")
        one, two = (sums.select(F.col("cluster").alias(f"c{k}"), F.col("size").alias(f"n{k}"), F.col("v").alias(f"v{k}")) for k in (1, 2))
        dot = F.aggregate(F.zip_with("v1", "v2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        pairs = one.join(two, F.col("c1") < F.col("c2"))  # as many as there are results
        value = dot / (F.col("n1") * F.col("n2"))
        return pairs.select("c1", "c2", (value if kind == "similarity" else 1 - value).alias(name))
    if measure == "cosine":
        members = dealt(assigned.select("vec_id", "cluster", "v"), "vec_id")
        found = in_turn(blocks(members, "vec_id"), lambda b: _linked_in_block(members, b, "max" if how == "nearest" else "min"))
        merge = F.max if how == "nearest" else F.min
        out = reduce(DataFrame.unionByName, found).groupBy("c1", "c2").agg(merge("sim").alias("sim"))
        return out if kind == "similarity" else out.select("c1", "c2", (1 - F.col("sim")).alias(name))
    value = (M.similarity if kind == "similarity" else M.distance)(measure, "v1", "v2")
    parts = []
    for b in blocks(assigned.select("vec_id", "cluster", "v"), "vec_id"):
        whole = b.agg(F.collect_list(F.struct(F.col("cluster").alias("c2"), F.col("v").alias("v2"))).alias("all"))
        met = assigned.select(F.col("cluster").alias("c1"), F.col("v").alias("v1")).crossJoin(F.broadcast(whole)).select("c1", "v1", F.inline("all")).filter("c1 < c2")
        parts.append(met.select("c1", "c2", value.alias("value")).groupBy("c1", "c2").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))
    both = reduce(DataFrame.unionByName, parts).groupBy("c1", "c2")
    return both.agg({"avg": F.sum("total") / F.sum("n"), "min": F.min("least"), "max": F.max("most")}[agg].alias(name))


def _grouped(block: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's clusters, where each one's vectors begin, and all unit vectors, cluster by cluster."""
    _, labels, m = _block(block, key, "cluster")
    names, column = np.unique(np.array(labels), return_inverse=True)
    order = np.argsort(column, kind="stable")
    return names, np.flatnonzero(np.diff(column[order], prepend=-1)), _unit(m)[order]


def _linked_in_block(assigned: DataFrame, block: DataFrame, how: str) -> DataFrame:
    """(c1, c2, sim), c1 < c2: the largest or least cosine of each cluster's members with those of the block; a task gives each pair of clusters once, or again after TILE_CELLS pairs."""
    held = block.sparkSession.sparkContext.broadcast(_grouped(block, "vec_id"))  # MAX_CENTRE_CELLS numbers
    ufunc = np.maximum if how == "max" else np.minimum
    kind = assigned.schema["cluster"].dataType.simpleString()

    def rows(found: dict, names: np.ndarray) -> pa.RecordBatch:
        own, values = np.array(list(found)), np.stack(list(found.values()))
        at, other = np.nonzero(own[:, None] < names[None, :])
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(names[other]), pa.array(values[at, other])], names=["c1", "c2", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, starts, m), found = held.value, {}
        for own, x in _tiles(batches, len(m)):
            if not len(names):
                continue
            sims = ufunc.reduceat(_unit(x) @ m.T, starts, axis=1)
            labels, column = np.unique(own, return_inverse=True)
            order = np.argsort(column, kind="stable")
            best = ufunc.reduceat(sims[order], np.flatnonzero(np.diff(column[order], prepend=-1)), axis=0)
            for c, row in zip(labels.tolist(), best, strict=True):
                found[c] = ufunc(found[c], row) if c in found else row.copy()
            if len(found) * len(names) > TILE_CELLS:
                yield rows(found, names)
                found = {}
        if found:
            yield rows(found, names)

    return assigned.select("cluster", "v").mapInArrow(run, f"c1 {kind}, c2 {kind}, sim double")


def grow_seeds(vectors: DataFrame, measure: str = "cosine", threshold: float = 0.2) -> DataFrame:
    """(vec_id, label): labelled vectors keep their label, others get the nearest labelled one's, or null under the threshold."""
    seeds = vectors.filter("label IS NOT NULL")
    rest = vectors.filter("label IS NULL")
    found = nearest(rest, seeds.select(F.col("vec_id").alias("centre"), F.col("v").alias("cv")), measure, threshold)
    named = found.join(seeds.select(F.col("vec_id").alias("centre"), "label"), "centre").select("vec_id", "label")
    return seeds.select("vec_id", "label").unionByName(rest.select("vec_id").join(named, "vec_id", "left"))


def _start(vectors: DataFrame, o: Options) -> list:
    """k starting vectors from a sample by hash: as they come, or far apart from one another."""
    turn = F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit(str(o.seed))).cast("binary"))
    some = vectors.orderBy(turn, "vec_id").limit(o.k if o.init == "random" else 2 * o.k + 1).collect()  # 2k + 1 rows
    held = [(r["vec_id"], np.array(r["v"])) for r in some]
    while len(held) > o.k:
        unit = _unit(np.array([v for _, v in held]))
        sims = np.round(unit @ unit.T, 12)  # so that of the nearest two the first goes
        np.fill_diagonal(sims, -2)
        del held[int(np.argmax(sims.max(axis=1)))]
    return held


def kmeans(vectors: DataFrame, o: Options = Options(), medoid: bool = False) -> DataFrame:
    """(vec_id, cluster): zero vectors are left out; ends when no label changes or after the iterations.

    Each round is one join with k broadcast centres and one aggregation; its result is
    written to the shared folder.
    """
    vectors = materialize(vectors.select("vec_id", "v").filter(F.exists("v", lambda x: x != 0)), "vectors")
    spark = vectors.sparkSession
    start = _start(vectors, o)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster long")
    centres = spark.createDataFrame([(i, v.tolist()) for i, (_, v) in enumerate(start)], "centre long, cv array<double>")
    assigned = None
    for _ in range(max(1, o.iterations)):
        now = materialize(nearest(vectors, centres, o.measure).select("vec_id", F.col("centre").alias("cluster")), "assigned")
        if assigned is not None:
            changed = now.join(assigned.withColumnRenamed("cluster", "was"), "vec_id").filter("cluster <> was").isEmpty()
            assigned = now
            if changed:
                break
        assigned = now
        members = vectors.join(assigned, "vec_id")
        if medoid:
            centres = medoids(members, o.measure, o.centroid).join(vectors, "vec_id").select(F.col("cluster").alias("centre"), F.col("v").alias("cv"))
        else:
            centres = centroids(members, o.centroid).select(F.col("cluster").alias("centre"), F.col("v").alias("cv"))
        centres = materialize(centres, "centres")
    return assigned


def _similar(measure: str):
    """The measure of one vector with the rows of a matrix, in numpy; cosine and Euclidean kinds."""
    if measure == "cosine":
        return lambda v, m: np.divide(m @ v, np.linalg.norm(m, axis=1) * np.linalg.norm(v), out=np.zeros(len(m)), where=np.linalg.norm(m, axis=1) * np.linalg.norm(v) > 0)
    if measure in ("euclidean", "squared_euclidean", "manhattan"):
        gap = {"euclidean": lambda d: np.sqrt((d * d).sum(1)), "squared_euclidean": lambda d: (d * d).sum(1), "manhattan": lambda d: np.abs(d).sum(1)}[measure]
        return lambda v, m: 1 - gap(m - v) if measure != "manhattan" else 1 / np.maximum(gap(m - v), 1e-300)
    raise ValueError(f"order-dependent clustering has no {measure!r}")


def leader(vectors: DataFrame, o: Options = Options(), group: str | None = None) -> DataFrame:
    """(vec_id, cluster) by one pass in vec_id order: a vector joins the most similar leader, or leads.

    A new cluster begins only below the threshold and while there are fewer than k. The
    pass is sequential by definition; it keeps k leaders, not the vectors. Give a group
    column to run one pass in each group.
    """
    like, k, least = _similar(o.measure), o.k, o.threshold

    def run(frames):
        heads: list[np.ndarray] = []
        for pdf in frames:
            out = []
            for v in pdf["v"]:
                v = np.asarray(v, dtype=float)
                sims = like(v, np.array(heads)) if heads else np.zeros(0)
                if not len(sims) or (sims.max() < least and len(heads) < k):
                    heads.append(v)
                    out.append(len(heads) - 1)
                else:
                    out.append(int(np.argmax(sims)))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": out})

    if group is None:
        return vectors.select("vec_id", "v").repartitionByRange(1, "vec_id").sortWithinPartitions("vec_id").mapInPandas(run, "vec_id long, cluster long")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return next(run([pdf])).assign(**{group: pdf[group].iloc[0]})

    kind = vectors.schema[group].dataType.simpleString()
    return vectors.select("vec_id", "v", group).groupBy(group).applyInPandas(one, f"vec_id long, cluster long, {group} {kind}")


def merge_rounds(vectors: DataFrame, o: Options = Options()) -> DataFrame:
    """(vec_id, cluster, path): average-linkage merging by cosine, all mutual nearest clusters at once.

    A cluster is its size and the sum of its unit vectors, so the mean cosine of two
    clusters is the inner product of their means, and what the neighbours of a merged
    cluster are follows from the next search. A merge never brings two clusters nearer to a third
    than the nearer one was, so merging every pair that are each other's nearest gives the
    tree that merging one pair after the other gives. The tree is then cut: the n - k
    merges of the highest similarity hold, ties by round and ids.
    """
    live = materialize(vectors.select(F.col("vec_id").alias("cluster"), F.lit(1).cast("bigint").alias("size"), normalize(F.col("v")).alias("v")), "live")
    n, rounds = live.count(), []
    while True:
        means = materialize(live.select(F.col("cluster").alias("vec_id"), F.transform("v", lambda x: x / F.col("size")).alias("v")), "means")
        best = materialize(neighbours(means, means, 1, "product").select("query", "vec_id", "sim"), "best")
        back = best.select(F.col("vec_id").alias("query"), F.col("query").alias("vec_id"))
        mutual = best.filter((F.col("query") < F.col("vec_id")) & (F.col("sim") >= o.threshold)).join(back, ["query", "vec_id"])
        mutual = materialize(mutual.select(F.col("query").alias("a"), F.col("vec_id").alias("b"), "sim", F.lit(len(rounds)).alias("round")), "merges")
        if mutual.isEmpty():
            break
        rounds.append(mutual)
        named = live.join(mutual.select(F.col("b").alias("cluster"), "a"), "cluster", "left").select(F.coalesce("a", "cluster").alias("cluster"), "size", "v")
        cells = named.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"))
        sums = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("v"))
        last, live = live, materialize(named.groupBy("cluster").agg(F.sum("size").alias("size")).join(sums, "cluster"), "live")
        for done in (last, means, best):
            discard(done)
    assigned = vectors.select("vec_id", F.col("vec_id").alias("top"), F.lit("").alias("path"))
    if rounds:
        merges = reduce(DataFrame.unionByName, rounds)
        held = materialize(dense_ids(merges.withColumn("far", -F.col("sim")), ["far", "round", "a"], "rank").filter(F.col("rank") < n - max(1, o.k)), "held")
        for r in range(len(rounds)):
            now = held.filter(F.col("round") == r)
            both = now.select(F.col("a").alias("top"), "a", F.lit("0").alias("bit")).unionByName(now.select(F.col("b").alias("top"), "a", F.lit("1").alias("bit")))
            joined = assigned.join(both, "top", "left")
            last, assigned = assigned, materialize(joined.select("vec_id", F.coalesce("a", "top").alias("top"), F.concat(F.coalesce("bit", F.lit("")), "path").alias("path")), "assigned")
            discard(last)
    tops = dense_ids(assigned.groupBy("top").agg(F.min("vec_id").alias("first")), ["first"], "cluster").select("top", "cluster")
    return assigned.join(tops, "top").select("vec_id", "cluster", F.concat(F.lit("B"), "path").alias("path"))


def agglomerate(vectors: DataFrame, o: Options = Options(), most: int = 5000) -> DataFrame:
    """(vec_id, cluster, path) by Brown-style merging of the two most similar clusters (average linkage).

    Stops at k clusters or below the threshold. path tells the merges from the top down
    ("B01": second child of the first). Cosine works for tables of any size
    (``merge_rounds``). The mean of other measures needs all pairs of members, so their input
    is a bounded table: more than so many vectors raise ValueError (cluster their centres).
    """
    if o.measure == "cosine":
        return merge_rounds(vectors, o)
    n = vectors.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} vectors")
    like = _similar(o.measure)
    k, least = o.k, o.threshold

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        m = np.stack(pdf["v"].map(lambda v: np.asarray(v, dtype=float)).to_list())
        sims = np.stack([like(v, m) for v in m])
        np.fill_diagonal(sims, -np.inf)
        size, live = np.ones(len(m)), np.ones(len(m), dtype=bool)
        tree: list = [i for i in range(len(m))]
        while live.sum() > max(1, k):
            at = int(np.argmax(sims))
            a, b = divmod(at, len(m))
            if sims[a, b] < least or not np.isfinite(sims[a, b]):
                break
            a, b = min(a, b), max(a, b)
            row = (sims[a] * size[a] + sims[b] * size[b]) / (size[a] + size[b])
            row[~live] = -np.inf
            row[a] = row[b] = -np.inf
            sims[a], sims[:, a] = row, row
            sims[b], sims[:, b] = -np.inf, -np.inf
            size[a] += size[b]
            live[b] = False
            tree[a] = (tree[a], tree[b])
        cluster, path = np.zeros(len(m), dtype=np.int64), [""] * len(m)
        for c, top in enumerate(np.flatnonzero(live)):
            stack = [(tree[top], "B")]
            while stack:
                node, name = stack.pop()
                if isinstance(node, tuple):
                    stack += [(node[0], name + "0"), (node[1], name + "1")]
                else:
                    cluster[node], path[node] = c, name
        return pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": cluster, "path": path})

    return vectors.select("vec_id", "v", F.lit(0).alias("all")).groupBy("all").applyInPandas(merge, "vec_id long, cluster long, path string")


def dbscan(vectors: DataFrame, o: Options = Options()) -> DataFrame:
    """(vec_id, cluster): density clusters by distance <= epsilon; noise has a null cluster, named by their least core."""
    near = materialize(within(vectors, o.epsilon, o.measure).select("vec_id", "other"), "near")
    crowded = near.groupBy("vec_id").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= o.min_points).select("vec_id")
    core = materialize(vectors.select("vec_id") if o.min_points <= 1 else crowded, "core")
    links = near.join(core, "vec_id").join(core.select(F.col("vec_id").alias("other")), "other")
    found = components(links.filter("vec_id < other").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    label = core.join(found.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("cluster"))
    label = materialize(label, "labels")
    border = near.join(label.select(F.col("vec_id").alias("other"), "cluster"), "other").groupBy("vec_id").agg(F.min("cluster").alias("reach"))
    return vectors.select("vec_id").join(label, "vec_id", "left").join(border, "vec_id", "left").select("vec_id", F.coalesce("cluster", "reach").alias("cluster"))


@dataclass(frozen=True)
class Reachability:
    """Written tables of a density order: near (vec_id, other, dist), cores (vec_id, core) and a forest (src, dst, len)."""

    vectors: DataFrame
    near: DataFrame
    cores: DataFrame
    forest: DataFrame
    epsilon: float


def optics(vectors: DataFrame, o: Options = Options()) -> Reachability:
    """The density structure of all epsilons up to o.epsilon at once.

    A vector's core distance is that of its (min_points - 1)-th neighbour within epsilon. Two
    cores reach one another at the largest of their distance and their core distances. The
    least spanning forest of these reaches holds all that any smaller epsilon connects:
    the cores that are connected by edges of at most that length.
    """
    near = materialize(within(vectors, o.epsilon, o.measure), "near")
    if o.min_points <= 1:
        cores = vectors.select("vec_id", F.lit(0.0).alias("core"))
    else:
        rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("dist", "other"))
        cores = near.withColumn("rank", rank).filter(F.col("rank") == o.min_points - 1).select("vec_id", F.col("dist").alias("core"))
    cores = materialize(cores, "cores")
    both = near.filter("vec_id < other").join(cores, "vec_id").join(cores.select(F.col("vec_id").alias("other"), F.col("core").alias("core2")), "other")
    edges = both.select(F.col("vec_id").alias("src"), F.col("other").alias("dst"), F.greatest("dist", "core", "core2").alias("len"))
    return Reachability(vectors.select("vec_id"), near, cores, materialize(spanning_forest(edges), "forest"), o.epsilon)


def optics_cut(found: Reachability, epsilon: float) -> DataFrame:
    """(vec_id, cluster): the clusters that dbscan finds with this epsilon, which is at most the one of the structure."""
    if epsilon > found.epsilon:
        raise ValueError(f"the structure ends at {found.epsilon}")
    core = found.cores.filter(F.col("core") <= epsilon).select("vec_id")
    tied = components(found.forest.filter(F.col("len") <= epsilon).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    label = core.join(tied.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("cluster"))
    label = materialize(label, "labels")
    border = found.near.filter(F.col("dist") <= epsilon).join(label.select(F.col("vec_id").alias("other"), "cluster"), "other").groupBy("vec_id").agg(F.min("cluster").alias("reach"))
    return found.vectors.join(label, "vec_id", "left").join(border, "vec_id", "left").select("vec_id", F.coalesce("cluster", "reach").alias("cluster"))


def optics_order(found: Reachability, levels: list[float]) -> DataFrame:
    """(place, vec_id, reach): an order in which the clusters of every level stand together, noise last, and the least level at which a vector is in one cluster with the one before it; null where none is.

    Vectors are sorted by their clusters from the widest level to the narrowest, so valleys of
    reach are clusters, as fine as the levels are.
    """
    steps = sorted({float(x) for x in levels}, reverse=True)
    rows = found.vectors
    for k, level in enumerate(steps):
        rows = rows.join(optics_cut(found, level).withColumnRenamed("cluster", f"at{k}"), "vec_id", "left")
    names = [f"at{k}" for k in range(len(steps))]
    # A missing cluster comes behind all others of its level.
    keys = [key for name in names for key in (F.col(name).isNull().alias(f"no_{name}"), F.coalesce(name, F.lit(0)).alias(f"is_{name}"))]
    placed = dense_ids(materialize(rows.select("vec_id", *names, *keys), "levels"), [*[c for name in names for c in (f"no_{name}", f"is_{name}")], "vec_id"], "place")
    placed = materialize(placed.select("place", "vec_id", *names), "order")
    before = placed.select((F.col("place") + 1).alias("place"), *[F.col(name).alias(f"b_{name}") for name in names])
    met = placed.join(before, "place", "left")
    reach = F.coalesce(*[F.when(F.col(name) == F.col(f"b_{name}"), F.lit(level)) for name, level in reversed(list(zip(names, steps, strict=True)))])
    return met.select("place", "vec_id", reach.alias("reach"))


def shared_neighbours(vectors: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """(a, b, shared), a < b: of mutual k nearest neighbours how many neighbours they share."""
    lists = neighbours(vectors, vectors, k, measure).groupBy("query").agg(F.collect_list("vec_id").alias("near"))
    lists = materialize(lists, "near")
    pairs = lists.select("query", F.explode("near").alias("other"), "near")
    both = pairs.join(lists.select(F.col("query").alias("other"), F.col("near").alias("theirs")), "other")
    mutual = both.filter((F.col("query") < F.col("other")) & F.array_contains("theirs", F.col("query")))
    return mutual.select(F.col("query").alias("a"), F.col("other").alias("b"), F.size(F.array_intersect("near", "theirs")).alias("shared"))


def membership_overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """(c1, c2, both, either): common members and members of either of each two clusters that meet."""
    a, b = one.select("vec_id", F.col("cluster").alias("c1")), other.select("vec_id", F.col("cluster").alias("c2"))
    met = a.join(b, "vec_id").groupBy("c1", "c2").agg(F.count("*").alias("both"))
    n1, n2 = a.groupBy("c1").agg(F.count("*").alias("n1")), b.groupBy("c2").agg(F.count("*").alias("n2"))
    return met.join(n1, "c1").join(n2, "c2").select("c1", "c2", "both", (F.col("n1") + F.col("n2") - F.col("both")).alias("either"))


def run(vectors: DataFrame, options: str | Options) -> DataFrame:
    """(vec_id, cluster) by the named method."""
    o = parse_options(options) if isinstance(options, str) else options
    if o.method in ("kmeans", "kmedoids"):
        return kmeans(vectors, o, o.method == "kmedoids")
    if o.method == "incremental":
        return leader(vectors, o)
    if o.method in ("agglomerative", "brown"):
        return agglomerate(vectors, o).select("vec_id", "cluster")
    if o.method == "dbscan":
        return dbscan(vectors, o)
    if o.method == "optics":
        return optics_cut(optics(vectors, o), o.epsilon)
    if o.method == "growseed":
        return grow_seeds(vectors, o.measure, o.threshold).withColumnRenamed("label", "cluster")
    raise ValueError(f"{o.method} gives links, not clusters: use shared_neighbours")


def generated_label(n) -> Column:
    return F.format_string("<CL_%04d>", n)


def is_generated(label) -> Column:
    return label.rlike(r"^<CL_[0-9]+>$")


def representatives(assigned: DataFrame, kind: str = "centroid", measure: str = "cosine") -> DataFrame:
    """(cluster, v): what stands for a cluster: its centroid, medoid, first member (prototype) or last (newest)."""
    if kind == "centroid":
        return centroids(assigned).select("cluster", "v")
    if kind == "medoid":
        return medoids(assigned, measure).join(assigned.select("vec_id", "v"), "vec_id").select("cluster", "v")
    pick = {"prototype": F.min_by, "newest": F.max_by}[kind]
    return assigned.groupBy("cluster").agg(pick("v", "vec_id").alias("v"))


def to_vectors(assigned: DataFrame, vectors: DataFrame, how: str, measure: str = "cosine", kind: str = "similarity", reverse: bool = False) -> DataFrame:
    """(cluster, vec_id, value): of each cluster with each vector the mean, furthest or nearest similarity or distance.

    reverse gives the measure its vectors in the other order, which matters for asymmetric ones.
    The mean cosine of a vector with a cluster is that with the mean of its unit vectors.
    """
    if measure == "cosine":
        members = assigned.select("vec_id", "cluster", "v").filter("v IS NOT NULL")
        if how == "average":
            sums = centroids(members.select("cluster", normalize(F.col("v")).alias("v")))
            members = sums.select(F.col("cluster").alias("vec_id"), "cluster", F.transform("v", lambda x: x / F.col("size")).alias("v"))
        sought = dealt(vectors.select("vec_id", "v").filter("v IS NOT NULL"), "vec_id")
        found = in_turn(blocks(members, "vec_id"), lambda b: _met_in_block(sought, b, how))
        merge = {"average": F.avg, "furthest": F.min, "nearest": F.max}[how]
        out = reduce(DataFrame.unionByName, found).groupBy("cluster", "vec_id").agg(merge("value").alias("value"))
        return out if kind == "similarity" else out.select("cluster", "vec_id", (1 - F.col("value")).alias("value"))
    order = ("v", "member") if reverse else ("member", "v")
    value = (M.similarity if kind == "similarity" else M.distance)(measure, *order)
    parts = []
    for b in blocks(assigned.select("vec_id", "cluster", "v"), "vec_id"):
        whole = b.agg(F.collect_list(F.struct("cluster", F.col("v").alias("member"))).alias("all"))
        met = vectors.select("vec_id", "v").crossJoin(F.broadcast(whole)).select("vec_id", "v", F.inline("all")).select("cluster", "vec_id", value.alias("value"))
        parts.append(met.groupBy("cluster", "vec_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))
    both = reduce(DataFrame.unionByName, parts).groupBy("cluster", "vec_id")
    low = (how == "furthest") == (kind == "similarity")
    return both.agg((F.sum("total") / F.sum("n") if how == "average" else F.min("least") if low else F.max("most")).alias("value"))


def _met_in_block(vectors: DataFrame, block: DataFrame, how: str) -> DataFrame:
    """(cluster, vec_id, value): the largest ("nearest") or least ("furthest") cosine of each vector with the block's members of each cluster; on "average" the inner product with the one mean of each."""
    if how == "average":
        names, m = _block(block, "cluster")
        facts = np.array(names), np.arange(len(names)), m
    else:
        facts = _grouped(block, "vec_id")
    held = block.sparkSession.sparkContext.broadcast(facts)  # MAX_CENTRE_CELLS numbers
    ufunc = {"average": np.add, "furthest": np.minimum, "nearest": np.maximum}[how]
    kinds = {f.name: f.dataType.simpleString() for f in (*block.schema, *vectors.schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, m = held.value
        for own, x in _tiles(batches, len(m)):
            if len(names):
                sims = ufunc.reduceat(_unit(x) @ m.T, starts, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(own))), pa.array(np.repeat(own, len(names))), pa.array(sims.ravel())], names=["cluster", "vec_id", "value"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"cluster {kinds['cluster']}, vec_id {kinds['vec_id']}, value double")


def separate_seeds(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled vectors and the others."""
    return vectors.filter("label IS NOT NULL"), vectors.filter("label IS NULL")


def merged(assigned: DataFrame, into, *others) -> DataFrame:
    """The assignment after other clusters' members went into one."""
    return assigned.withColumn("cluster", F.when(F.col("cluster").isin(*others), F.lit(into)).otherwise(F.col("cluster")))


def extract_clusters(labelled: DataFrame) -> DataFrame:
    """(cluster, label, size, members): vectors (vec_id, label) by label, numbered in the order in which labels are first seen by vec_id; unlabelled ones are left out."""
    groups = labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    return dense_ids(groups, ["first"], "cluster").select("cluster", "label", "size", "members")


def all_sparse_or_dense(vectors: DataFrame) -> bool:
    """Whether the vectors of a table are all of one kind: all with a sparse map or all with a dense array; columns dense and sparse, of which a row has one."""
    n = vectors.agg(F.count("*").alias("all"), F.count("dense").alias("dense"), F.count("sparse").alias("sparse")).first()
    return (n["dense"], n["sparse"]) in ((n["all"], 0), (0, n["all"]))


def updated_representative(clusters: DataFrame, newcomers: DataFrame) -> DataFrame:
    """(cluster, size, v): sums after newcomers (cluster, v) joined clusters (cluster, size, v), without a look at old members."""
    more = centroids(newcomers).select("cluster", F.col("size").alias("more"), F.col("v").alias("w"))
    both = clusters.join(more, "cluster", "full_outer")
    total = F.when(F.col("v").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return both.select("cluster", (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"), total.alias("v"))


def representative_similarity(assigned: DataFrame, kind: str = "centroid", measure: str = "cosine") -> DataFrame:
    """(c1, c2, sim), c1 < c2: similarity of what stands for two clusters."""
    held = materialize(representatives(assigned, kind, measure), "representatives")
    one, two = (held.select(F.col("cluster").alias(f"c{k}"), F.col("v").alias(f"v{k}")) for k in (1, 2))
    return one.join(two, F.col("c1") < F.col("c2")).select("c1", "c2", M.similarity(measure, "v1", "v2").alias("sim"))


def flatten(paths: DataFrame, depth: int = 1) -> DataFrame:
    """(vec_id, cluster) from merge paths: members whose paths agree down to the depth are one cluster."""
    return paths.select("vec_id", F.substring("path", 1, depth + 1).alias("cluster"))


def same_clusters(one: DataFrame, other: DataFrame) -> bool:
    """Whether two assignments group the same vectors alike, whatever the clusters' names."""
    met = membership_overlap(one, other)
    return met.filter(F.col("both") != F.col("either")).isEmpty() and one.select("vec_id").exceptAll(other.select("vec_id")).isEmpty() and other.select("vec_id").exceptAll(one.select("vec_id")).isEmpty()
