"""Hard negatives by a dual-tree search over anchors and candidates.

Vectors become whole numbers floor(256 * x). Candidates are kept as trees: every task
halves its rows in pieces of at most ``TREE_ROWS``, again and again at the widest gap near
the median of the direction in which they spread most, down to leaves of about ``LEAF``
rows, and writes each tree
as one row (its vectors in tree order, centre and radius of every node, once). The anchors
of a block make a tree as well, which goes to all tasks.

A pair of nodes with centres a, c and radii r, s holds inner products within
a.c +- (r |c| + s |a| + r s). A walk from the pair of roots drops every pair whose interval
cannot hold a wanted score of any anchor below the node, so whole groups of anchors are
left out at once; pairs of leaves that remain are scored exactly. The search runs twice
for a block: first for the positives, where an anchor wants scores at or above the fifth
best of its label found so far, then for the negatives, where it wants scores within a
window [80 %, 100 %] of a positive and, once five are found, at or above the fifth. What is
found among the block's own anchors is known before the walk begins. Each task hands on
five rows at most for an anchor and positive; a ranked window merges them.

Anchors come in blocks of ``BLOCK`` rows, one after the other, and each block's result is
written before the next begins, so that the driver and a task hold one block at a time.

Defined results: rows with a null vec_id, a null label, a null or empty vector or a null or
non-finite component take no part. Rows that share a vec_id are rows of their own, each
with a place among others' results; they are never one another's positives or negatives,
and as anchors each has results. Among rows of equal score and vec_id the order is by label
(results do not show which). An anchor without positives, or a positive without negatives,
gives no rows. Vectors of more than one length, and numbers whose inner products may leave
the range of a long, raise ValueError. Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import materialize, parts_of, read_table, shared_dir

SCALE, EVERY, RELABEL, LABELS = 256, 100, 7, 10
#: Positives of an anchor, negatives of a positive, and the window of their scores in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
TREE_ROWS, LEAF, BLOCK = 8192, 128, 4096

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(embeddings: DataFrame, scale: int = SCALE, relabel: int = RELABEL, labels: int = LABELS) -> DataFrame:
    """(vec_id, label, x array<bigint>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    label = F.when(F.pmod("vec_id", F.lit(relabel)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


# ---- trees ----


@dataclass(frozen=True)
class Tree:
    """Rows in tree order; node k has the children 2k + 1 and 2k + 2 and holds the rows from start to stop."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> int:
        """Number of the first leaf; all leaves are on one level."""
        return len(self.start) // 2


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """A full binary tree; each node is cut in two across the direction in which its rows spread most."""
    n, depth = len(ids), 0
    while (n >> depth) > leaf:
        depth += 1
    nodes = (2 << depth) - 1
    order, start, stop = np.arange(n), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    centre, radius = np.zeros((nodes, x.shape[1])), np.zeros(nodes)
    stop[0], real = n, x.astype(np.float64)
    for k in range(nodes):
        a, b = start[k], stop[k]
        own = real[order[a:b]]
        if b > a:
            centre[k] = own.mean(axis=0)
            # A little more than measured, for the rounding of the measure itself.
            radius[k] = np.sqrt(((own - centre[k]) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-9
        if k < nodes // 2:
            half = (b - a) // 2
            if half:
                # At the widest gap of the middle half, so that groups stay together.
                far = own[np.argmax(((own - centre[k]) ** 2).sum(axis=1))] - centre[k]
                # Two power steps from the farthest row lead towards the widest direction.
                for _ in range(2):
                    far = (own - centre[k]).T @ ((own - centre[k]) @ far)
                    far /= np.linalg.norm(far) or 1.0
                along = own @ far
                turn = np.argsort(along, kind="stable")
                order[a:b], along = order[a:b][turn], along[turn]
                near, wide = (b - a) // 4, max(1, (b - a) // 2)
                half = near + 1 + int(np.argmax(np.diff(along[near : near + wide + 1]))) if b - a > 3 else half
            start[2 * k + 1], stop[2 * k + 1], start[2 * k + 2], stop[2 * k + 2] = a, a + half, a + half, b
    return Tree(ids[order], labels[order], x[order], start, stop, centre, radius)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors have more than one length")
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), flat.reshape(len(sizes), -1)


TREE_SCHEMA = "size long, dims long, top long, ids binary, labels binary, x binary, start binary, stop binary, centre binary, radius binary"
_KINDS = {"ids": np.int64, "labels": np.int64, "x": np.int64, "start": np.int64, "stop": np.int64, "centre": np.float64, "radius": np.float64}


def trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row for each tree; rows stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts_of(b, tree_rows)):
            if batch.num_rows:
                t = build(*_columns(batch))
                made = [pa.array([getattr(t, k).astype(kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()]
                facts = [pa.array([int(k)], pa.int64()) for k in (len(t.ids), t.x.shape[1], np.abs(t.x).max(initial=0))]
                yield pa.RecordBatch.from_arrays([*facts, *made], names=["size", "dims", "top", *_KINDS])

    return rows.select("vec_id", "label", "x").mapInArrow(run, TREE_SCHEMA)


def _read_tree(batch: pa.RecordBatch, row: int) -> Tree:
    held = {k: np.frombuffer(batch.column(3 + i)[row].as_buffer(), dtype=kind) for i, (k, kind) in enumerate(_KINDS.items())}
    dims = batch.column(1)[row].as_py()
    return Tree(**{**held, "x": held["x"].reshape(-1, dims), "centre": held["centre"].reshape(-1, dims)})


# ---- the search ----


class Best:
    """The best rows found for some wants, a want being an anchor with a window of scores: lists by (score, vec_id)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most
        self.least = low.copy()  # no score below can be among the best any more
        self.want, self.ids, self.scores = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, want: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(want):
            return
        touched = np.zeros(len(self.low), dtype=bool)
        touched[want] = True
        old = touched[self.want]
        want, ids, scores = (np.concatenate([a[old], b]) for a, b in ((self.want, want), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, want))
        want, ids, scores = want[order], ids[order], scores[order]
        first = np.flatnonzero(np.diff(want, prepend=-1))
        place = np.arange(len(want)) - np.repeat(first, np.diff(np.append(first, len(want))))
        last = place == self.most - 1
        self.least[want[last]] = np.maximum(self.least[want[last]], scores[last])
        keep = place < self.most
        self.want, self.ids, self.scores = (np.concatenate([a[~old], b[keep]]) for a, b in ((self.want, want), (self.ids, ids), (self.scores, scores)))


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; as doubles, through BLAS, where all sums stay under 2^53."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top >= 2**63:
        raise ValueError("inner products may leave the range of a long")
    return a @ b.T


def search(anchors: Tree, candidates: Tree, best: Best, wants: int, same: bool) -> int:
    """Add to best what the candidates hold for want w of anchor a (number a * wants + w); gives the number of pairs of rows scored."""
    scored, low, high = 0, best.least.reshape(-1, wants), best.high.reshape(-1, wants)
    if anchors.x.shape[1] != candidates.x.shape[1]:
        raise ValueError("vectors have more than one length")
    norm_a, norm_c = np.linalg.norm(anchors.centre, axis=1), np.linalg.norm(candidates.centre, axis=1)
    live = high >= low
    # The least wanted and the most wanted score below each anchor node.
    floor, roof = np.full(len(anchors.start), np.inf), np.full(len(anchors.start), -np.inf)
    lows, highs = np.where(live, low, np.inf).min(axis=1, initial=np.inf), np.where(live, high, -np.inf).max(axis=1, initial=-np.inf)
    for k in range(len(anchors.start) - 1, -1, -1):
        if k >= anchors.leaves:
            own = slice(anchors.start[k], anchors.stop[k])
            floor[k], roof[k] = lows[own].min(initial=np.inf), highs[own].max(initial=-np.inf)
        else:
            floor[k], roof[k] = min(floor[2 * k + 1], floor[2 * k + 2]), max(roof[2 * k + 1], roof[2 * k + 2])

    def bounds(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = np.einsum("ij,ij->i", anchors.centre[a], candidates.centre[c])
        slack = anchors.radius[a] * norm_c[c] + candidates.radius[c] * norm_a[a] + anchors.radius[a] * candidates.radius[c]
        slack += 1e-9 * (norm_a[a] * norm_c[c] + slack) + 1e-6
        return middle - slack, middle + slack

    a, c = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        under, over = bounds(a, c)
        hold = (anchors.stop[a] > anchors.start[a]) & (candidates.stop[c] > candidates.start[c]) & (over >= floor[a]) & (under <= roof[a])
        a, c, over = a[hold], c[hold], over[hold]
        if not ((a < anchors.leaves).any() or (c < candidates.leaves).any()):
            break
        down = a < anchors.leaves
        a, c = np.concatenate([np.where(down, 2 * a + 1, a), 2 * a[down] + 2]), np.concatenate([c, c[down]])
        down = c < candidates.leaves
        a, c = np.concatenate([a, a[down]]), np.concatenate([np.where(down, 2 * c + 1, c), 2 * c[down] + 2])
    for leaf in np.unique(a):
        own = slice(anchors.start[leaf], anchors.stop[leaf])
        rest, roofs = c[a == leaf], over[a == leaf]
        order = np.argsort(-roofs, kind="stable")
        rest, roofs, step = rest[order], roofs[order], 2
        # The most promising leaves first; what they give rules out others.
        while len(rest) and (live[own] & (low[own] <= roofs[0])).any():
            some, rest, roofs, step = rest[:step], rest[step:], roofs[step:], step * 2
            scored += _score_leaves(anchors, candidates, best, wants, same, np.arange(own.start, own.stop), some)
            still = roofs >= np.where(live[own], low[own], np.inf).min()
            rest, roofs = rest[still], roofs[still]
    return scored


def _score_leaves(anchors: Tree, candidates: Tree, best: Best, wants: int, same: bool, rows: np.ndarray, leaves: np.ndarray) -> int:
    """Score the anchors rows against the candidates of some leaves; gives the number of pairs."""
    there = np.concatenate([np.arange(candidates.start[k], candidates.stop[k]) for k in leaves])
    got = scores_of(anchors.x[rows], candidates.x[there])
    fit = (anchors.labels[rows][:, None] == candidates.labels[there][None, :]) == same
    fit &= anchors.ids[rows][:, None] != candidates.ids[there][None, :]
    for w in range(wants):
        least, most = best.least.reshape(-1, wants)[rows, w], best.high.reshape(-1, wants)[rows, w]
        mask = fit & (got >= least[:, None]) & (got <= most[:, None])
        if not mask.any():
            continue
        if len(there) > best.most:
            # Only what ties with or beats a row's own fifth best.
            cut = np.where(mask, got, np.iinfo(np.int64).min)
            cut = np.partition(cut, len(there) - best.most, axis=1)[:, len(there) - best.most]
            mask &= got >= cut[:, None]
        at, to = np.nonzero(mask)
        best.add(rows[at] * wants + w, candidates.ids[there[to]], got[at, to])
    return got.size


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks' rows (want, vec_id, score), with their rank."""
    rank = F.row_number().over(Window.partitionBy("want").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def _found(held: DataFrame, anchors: Tree, start: Best, wants: int, same: bool) -> DataFrame:
    """(want, vec_id, score) that each task finds in its trees; what is known of the block itself bounds the search from the start."""
    send = held.sparkSession.sparkContext.broadcast((anchors, start.least, start.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least, high = send.value
        best = Best(least, high, start.most)
        for batch in batches:
            for k in range(batch.num_rows):
                search(own, _read_tree(batch, k), best, wants, same)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.want, best.ids, best.scores)], names=["want", "vec_id", "score"])

    return held.mapInArrow(run, "want long, vec_id long, score long")


def positives_of(held: DataFrame, anchors: Tree, most: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of the positives by anchor and rank; -1 as vec_id and score where there are fewer (rank absent)."""
    n, ends = len(anchors.ids), np.iinfo(np.int64)
    known = Best(np.full(n, ends.min), np.full(n, ends.max), most)
    search(anchors, anchors, known, 1, True)
    ids, scores, there = np.zeros((n, most), dtype=np.int64), np.zeros((n, most), dtype=np.int64), np.zeros((n, most), dtype=bool)
    for r in _merged(_found(held, anchors, known, 1, True), most).collect():  # most rows of each anchor of a block
        ids[r["want"], r["rank"] - 1], scores[r["want"], r["rank"] - 1], there[r["want"], r["rank"] - 1] = r["vec_id"], r["score"], True
    return ids, np.where(there, scores, -1)


def negatives_of(held: DataFrame, anchors: Tree, positive_ids: np.ndarray, positive_scores: np.ndarray, most: int, low: int, high: int) -> DataFrame:
    """SCHEMA for the anchors of a block; positives with a negative score have an empty window."""
    wants = positive_scores.shape[1]
    there = positive_scores >= 0
    # The window in whole scores: low * p <= 100 * s <= high * p.
    least = np.where(there, -((-low * positive_scores) // 100), 1)
    roof = np.where(there, high * positive_scores // 100, 0)
    known = Best(least.ravel(), roof.ravel(), most)
    search(anchors, anchors, known, wants, False)
    spark, rows = held.sparkSession, _merged(_found(held, anchors, known, wants, False), most)
    facts = pa.table({"want": np.arange(least.size), "anchor_id": np.repeat(anchors.ids, wants), "positive_id": positive_ids.ravel(), "positive_score": positive_scores.ravel()})
    names = spark.createDataFrame(facts)  # POSITIVES rows of each anchor of a block
    out = rows.join(F.broadcast(names), "want")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(embeddings: DataFrame, is_anchor: Callable = lambda i: F.pmod(i, F.lit(EVERY)) == 0, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """SCHEMA: the negatives of each anchor and positive, best first."""
    spark = embeddings.sparkSession
    rows = prepared(embeddings)
    held = materialize(trees(rows), "trees")
    facts = held.agg(F.min("dims"), F.max("dims")).first()
    if facts[0] is None:
        return spark.createDataFrame([], SCHEMA)
    if facts[0] != facts[1]:
        raise ValueError("vectors have more than one length")
    anchors = materialize(rows.filter(is_anchor(F.col("vec_id"))), "anchors")
    count = anchors.count()
    blocks = max(1, -(-count // block))
    path = f"{shared_dir(spark)}/textloom/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    for b in range(blocks if count else 0):
        own = anchors.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b).select("vec_id", "label", "x")
        table = own.toArrow().combine_chunks()  # about block rows
        if not table.num_rows:
            continue
        made = build(*_columns(table.sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks().to_batches()[0]), leaf=LEAF // 4)
        ids, scores = positives_of(held, made, positives)
        negatives_of(held, made, ids, scores, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH p AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.x, b.x)]) AS BIGINT) AS s
  FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT positive.a AS anchor_id, positive.b AS positive_id, CAST(row_number() OVER (PARTITION BY positive.a, positive.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank,
  s.b AS negative_id, positive.s AS positive_score, s.s AS negative_score
FROM positive JOIN s ON s.a = positive.a AND NOT s.same AND 80 * positive.s <= 100 * s.s AND s.s <= positive.s
QUALIFY rank <= 5"""
