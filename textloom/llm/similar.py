"""All pairs of texts whose word shingles have a Jaccard similarity of a given share or more.

An exact set-similarity join by prefixes. The shingles of all texts stand in one order:
those that a sample of the texts has more than once come last, by their count there, and
the others by their hash. Of two sets with a similarity of at least s, each holds at
least s times its size in common with the other, so the two share one of their first
n - ceil(s n) + 1 shingles in that order. Any order finds all pairs; the sample only
keeps cells of common shingles small.

The positions in that order prune more. Of two similar sets the smaller one already has a
shared shingle among its first n - ceil(2 s / (1 + s) n) + 1. And where the first shared
shingle stands, no more can be shared than what either set has from there on, which must be at
least s / (1 + s) of both sizes together. So a text that consists of a common passage and
words of its own, and has that passage's shingles only behind the others, leaves the cell of
such a shingle for which even the smallest text there is too large a partner.

Candidates are made in three rounds, since near copies in a large group share most of
their cells. First each text of a cell meets the cell's smallest one. Then the texts of a large
cell, in the order of the shingles that follow its own, meet the few behind them, which in a
group are the most alike. Last all members of a cell meet, but for those that are in one
component already: such a pair could add no component. Shared first shingles are counted for each pair: with c of them, no more than
c + ceil(s n) - 1 of all can be shared, n the larger set's size, which leaves out most
pairs that only have a passage in common. The others are verified over all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, materialize, parts_of, utf8

SEED = 42
#: Texts of the sample for the order, and the shingles of it that may count as common.
SAMPLE, MOST_COMMON = 20_000, 50_000
#: Texts behind it in a cell's order that a text meets in the second round, and the members of a cell from which there is one.
BEHIND, LARGE_CELL = 8, 16
#: Pairs whose ids go to the executors as a list to pick their texts.
MOST_PAIRS = 1_000_000


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 values of all shingles, sorted; a text with fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h, held = xxhash.xxh64_intdigest, []
    n = max(1, len(words) - shingle + 1)
    # In pieces, so that a very long text takes bounded memory.
    for a in range(0, n, 100_000):
        b = min(n, a + 100_000)
        if n == 1:
            made = [h(b" ".join(words), SEED)]
        else:
            made = [h(b" ".join(s), SEED) for s in zip(*[words[i + a : i + b] for i in range(shingle)], strict=True)]
        held.append(np.array(made, dtype=np.uint64))
    return np.unique(np.concatenate(held))


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and their counts) of the shingles that a sample of the texts has more than once."""
    each = max(1, texts.count() // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(each)) == 0)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle) for t in utf8(batch.column(0))]
        return {"s": np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)}

    counts = map_batches(some, ["text"], run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    got = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    hashes, n = got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix_of(found: np.ndarray, common: np.ndarray, counts: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set in the order of all; share is a fraction."""
    n, (over, under) = len(found), share
    if not n:
        return found
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: n - -(-over * n // under) + 1]


def shingle_sets(texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(id, fp, n, prefix, marks) of each distinct set of shingles: the row of one text with it, its size, its first shingles in order, and their lower halves."""
    common, counts = common_shingles(texts, shingle)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle) for t in utf8(batch.column(2))]
        return {
            "id": batch.column(0),
            "fp": batch.column(1),
            "key": pa.array([np.int64(xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63)) for x in sets], pa.int64()),
            "n": pa.array([len(x) for x in sets], pa.int32()),
            "prefix": pa.array([prefix_of(x, common, counts, share).view(np.int64) for x in sets], pa.list_(pa.int64())),
        }

    sets = map_batches(texts, ["id", "fp", "text"], run, "id long, fp long, key long, n int, prefix array<long>")
    # Fingerprint and key together identify a set; equal sets have equal prefixes.
    first = F.min_by(F.struct("id", "n", "prefix"), "id")
    sets = sets.filter("n > 0").groupBy("fp", "key").agg(first.alias("s")).select("s.id", "fp", "s.n", "s.prefix")
    return sets.withColumn("marks", F.transform("prefix", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))


def shared_cells(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(cell, id, fp, n, rest, early, next, first, members) of the sets' first shingles, those that others may share with enough behind them.

    rest: how many shingles the set has from this one on; early: whether it stands among
    those that the smaller of two similar sets shares one of; first (n, id, rest): of the
    cell's smallest early member; next: halves of the two shingles that follow in the set's order.
    """
    over, under = share
    held = sets.select("id", "fp", "n", "prefix", F.posexplode("prefix").alias("at", "cell"))
    half = lambda k: F.coalesce(F.get("prefix", F.col("at") + k), F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF))
    held = held.withColumn("next", F.shiftleft(half(1), 32).bitwiseOR(half(2))).drop("prefix")
    n = F.col("n").cast("long")
    early = F.col("at") <= n - F.ceil(n * (2 * over) / (over + under))
    # The largest partner that leaves enough to share.
    most = F.floor(F.col("rest") * (over + under) / over) - n
    held = held.select("cell", "id", "fp", "n", (n - F.col("at")).alias("rest"), early.alias("early"), "next")
    cell = Window.partitionBy("cell")
    first = F.min(F.when(F.col("early"), F.struct("n", "id", "rest"))).over(cell)
    held = held.withColumn("first", first).filter(most >= F.col("first.n"))
    return held.withColumn("members", F.count("*").over(cell)).filter("members > 1")


def enough(n_x: Column, rest_x: Column, n_y: Column, rest_y: Column, share: tuple[int, int]) -> Column:
    """Whether sets of these sizes may be as similar as share if their first shared shingle has so many from it on."""
    over, under = share
    sizes = F.least(n_x, n_y).cast("long") * under >= F.greatest(n_x, n_y).cast("long") * over
    return sizes & (F.least(rest_x, rest_y) * (over + under) >= (n_x + n_y).cast("long") * over)


def can_reach(n_x: Column, n_y: Column, shared: Column, share: tuple[int, int]) -> Column:
    """Whether sets of these sizes with so many shared first shingles may be as similar as share."""
    over, under = share
    n = F.greatest(n_x, n_y).cast("long")
    rest = F.floor((n * over + (under - 1)) / under).cast("long") - 1
    return (shared + rest) * (over + under) >= (n_x + n_y).cast("long") * over


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): the fingerprints, a < b, of those pairs (x, y) of ids whose sets are as similar as share."""
    over, under = share
    pairs = materialize(pairs, "pairs")
    texts = only(texts, pairs)
    x = texts.select(F.col("id").alias("x"), F.col("fp").alias("fp_x"), F.col("text").alias("text_x"))
    y = texts.select(F.col("id").alias("y"), F.col("fp").alias("fp_y"), F.col("text").alias("text_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole)):
            keep = []
            for p, q in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                s, t = shingle_set(p, shingle), shingle_set(q, shingle)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(under * both >= over * (len(s) + len(t) - both))
            good = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(good.columns, names=["p", "q"])

    near = pairs.join(x, "x").join(y, "y").select("fp_x", "fp_y", "text_x", "text_y").mapInArrow(run, "p long, q long")
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id stands in one of the written pairs (x, y); a list of ids goes to the executors only while it is short."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    return rows.join(F.broadcast(ids) if pairs.count() <= MOST_PAIRS else ids, "id", "left_semi")


def plausible(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those pairs (x, y) of ids that share enough first shingles; halves of shingles that agree by chance only add to these."""
    pairs = materialize(pairs.distinct(), "pairs")
    held = only(sets.select("id", "n", "marks"), pairs)
    x = held.select(F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("marks").alias("p_x"))
    y = held.select(F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("marks").alias("p_y"))
    # Two shingles of a set may have one mark, which the intersection holds once.
    shared = F.size(F.array_intersect("p_x", "p_y")) + F.size("p_x") - F.size(F.array_distinct("p_x"))
    return pairs.join(x, "x").join(y, "y").filter(can_reach(F.col("n_x"), F.col("n_y"), shared, share)).select("x", "y")


def first_links(cells: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(a, b) of the first round: each member of a cell with its smallest one."""
    met = cells.filter((F.col("id") != F.col("first.id")) & enough(F.col("n"), F.col("rest"), F.col("first.n"), F.col("first.rest"), share))
    return verified(plausible(met.select(F.col("id").alias("x"), F.col("first.id").alias("y")), sets, share), texts, shingle, share)


def in_components(cells: DataFrame, linked: DataFrame) -> DataFrame:
    """The cells' rows with the component that a text is in so far, its own fingerprint if in none."""
    rows = cells.join(linked, cells["fp"] == linked["node"], "left")
    return rows.select("cell", "id", "n", "rest", "early", "next", F.coalesce("component", "fp").alias("component"))


def next_links(cells: DataFrame, sets: DataFrame, linked: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(a, b) of the second round: each member of a cell with the BEHIND after it in the order of the following shingles.

    The order is one over all cells in ranges, so no task has a whole cell; what stands at
    two ranges' border meets in the last round.
    """
    order = ["cell", "next", "n", "id"]
    rows = in_components(cells.filter(F.col("members") >= LARGE_CELL), linked).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    behind = Window.partitionBy("part").orderBy(*order)
    held = [F.lead(F.struct("cell", "id", "n", "rest", "early", "component"), k).over(behind) for k in range(1, BEHIND + 1)]
    fits = lambda o: (
        (o["cell"] == F.col("cell"))
        & (o["component"] != F.col("component"))
        & (F.col("early") | o["early"])
        & enough(F.col("n"), F.col("rest"), o["n"], o["rest"], share)
    )
    # What does not fit goes before it becomes a row.
    met = rows.withColumn("others", F.array(*held)).select("id", F.explode(F.filter("others", fits)).alias("other"))
    pairs = met.select(F.greatest("id", "other.id").alias("x"), F.least("id", "other.id").alias("y"))
    return verified(plausible(pairs, sets, share), texts, shingle, share)


def other_links(cells: DataFrame, sets: DataFrame, linked: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(a, b) of the last round; linked: (node, component) of the fingerprints in components so far."""
    named = in_components(cells, linked).drop("next")
    x, y = (named.select(F.col("cell").alias(f"cell_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "rest", "early", "component")]) for k in ("x", "y"))
    met = (
        (F.col("cell_x") == F.col("cell_y"))
        & F.col("early_y")
        & (F.struct("n_y", "id_y") < F.struct("n_x", "id_x"))
        & (F.col("component_x") != F.col("component_y"))
        & enough(F.col("n_x"), F.col("rest_x"), F.col("n_y"), F.col("rest_y"), share)
    )
    pairs = x.join(y.filter("early_y"), met).select(F.col("id_x").alias("x"), F.col("id_y").alias("y"))
    return verified(plausible(pairs, sets, share), texts, shingle, share)
