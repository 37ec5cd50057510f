"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to 32 counts, the set bits of each 2-bit segment. The
Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints: a lower bound. The counts are held in unary (a bit each for "at least
one" and "both"), so a vector fits 64 bits and the Manhattan distance is the popcount
of an exclusive or.

Range-join: the 32 dimensions are dealt into g groups. Of vectors within Manhattan
distance 3 at least g - 3 groups are equal, so each vector stands in C(g, 3) grids,
each with the cells of g - 3 groups as its key, and partners meet in a cell of one
of them. The join verifies the lower bound, then the exact Hamming distance. g follows
the number of fingerprints, so that cells stay near one vector each; with every g all
that lie within the radius meet. Where fingerprints lie denser, as in families of one
template, a cell with more than ``DENSE`` members is not joined: all members of such cells
go on to grids of more groups, and what is dense there too to grids over the bits
themselves in 16 groups, where a cell cannot hold more than 2^12 fingerprints. Any pair
within the radius meets in a cell of every grid, so none is lost, and no fingerprint meets
a number of others that grows with the input. Members of a cell meet its least one, and only
those that are not near it meet all others, so families make stars.

Only distinct fingerprints are joined, so copies make no pairs. Components come from
star rounds over the links (``graph.components``), all as tables.

Defined results: a null or empty text has no words and the fingerprint zero, linked
like any other; a null doc_id never names a component unless all its rows have none;
repeated rows get equal results; other columns are ignored by the query and kept by
``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from textloom.llm import similar
from textloom.llm.common import documents, map_batches, map_whole, materialize, named, parts_of, read_table, unused, utf8, with_fields
from textloom.llm.graph import components
from textloom.operators.tables import discard

SEED, SHINGLE, RADIUS = 42, 3, 3
#: A fingerprint with more than 1/HOT of all rows is not left to one task.
HOT = 256
EVEN = 0x5555555555555555
#: Members of a cell that are joined; the finer grids that larger cells go on to, 0 for those over bits.
DENSE, FINER = 64, (8, 12, 0)
#: What a segment's count tells about a fingerprint, in bits.
SEGMENT_BITS = 1.45


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half the shingles' XXH64; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), seed)
    counts, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    # In pieces, so that a very long text takes bounded memory.
    for a in range(0, n, 100_000):
        b = min(n, a + 100_000)
        parts = [words[i + a : i + b] for i in range(shingle)]
        hashes = np.array([h(b" ".join(s), seed) for s in zip(*parts, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with all its columns and the fingerprint, as a signed 64-bit number, after them."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole)):
            made = pa.array([signed(fingerprint(t, shingle)) for t in utf8(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return map_whole(docs, run, with_fields(docs, **{name: "long"}))


def embedded(fp: Column) -> Column:
    """The 32 segments' counts in unary."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(EVEN))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grids(groups: int, radius: int = RADIUS) -> list[int]:
    """A mask of 64 bits, signed, for each choice of groups - radius groups of segments."""
    bounds = [32 * i // groups for i in range(groups + 1)]
    parts = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [signed(sum(chosen)) for chosen in combinations(parts, groups - radius)]


def groups_for(n: int, radius: int = RADIUS) -> int:
    """The number of groups with the least work: rows in the grids and pairs met in cells."""

    def work(g: int) -> float:
        return comb(g, radius) * (1 + n / 2 ** (SEGMENT_BITS * 32 * (g - radius) / g + 1))

    return min(range(radius + 1, 13), key=work)


def grid_cells(nodes: DataFrame, groups: int, radius: int = RADIUS) -> DataFrame:
    """(grid, cell, fp): each distinct fingerprint in every grid; with 0 groups its bits in 16 groups of four instead of counts."""
    if groups:
        masks, key = grids(groups, radius), embedded(F.col("fp"))
    else:
        parts = [15 << 4 * i for i in range(16)]
        masks, key = [signed(sum(chosen)) for chosen in combinations(parts, 16 - radius)], F.col("fp")
    held = nodes.filter("fp IS NOT NULL").select("fp", key.alias("v"), F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("grid", "mask"))
    return held.select("grid", F.col("v").bitwiseAND(F.col("mask")).alias("cell"), "fp")


def near(a: Column, b: Column, radius: int) -> Column:
    """The Manhattan bound, then the exact distance."""
    return (F.bit_count(embedded(a).bitwiseXOR(embedded(b))) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def links(nodes: DataFrame, groups: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect whatever links of at most radius bits between distinct fingerprints connect.

    Each member of a cell meets the cell's least one. Those that are within the radius of
    it are connected by it and need not meet one another; only the others meet all members of
    the cell. Members of cells that are too large meet in the next finer grid.
    """
    out, rest = [], nodes.select("fp")
    for level in (groups, *[g for g in FINER if g > groups or not g]):
        cells = materialize(grid_cells(rest, level, radius), "cells")
        sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("members"), F.min("fp").alias("first")).filter("members > 1")
        sizes = materialize(sizes, "cell-sizes")
        out.append(materialize(_met(cells, sizes if not level else sizes.filter(F.col("members") <= DENSE), radius), "links"))
        dense = sizes.filter(F.col("members") > DENSE).select("grid", "cell")
        if not level or dense.isEmpty():
            break
        rest = materialize(cells.join(dense, ["grid", "cell"], "left_semi").select("fp").distinct(), "dense")
        discard(cells)
        discard(sizes)
    return reduce(DataFrame.unionByName, out).distinct()


def _met(cells: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """The links (a, b) found in the cells of sizes (grid, cell, first)."""
    held = cells.join(sizes.select("grid", "cell", "first"), ["grid", "cell"]).withColumn("tied", near(F.col("fp"), F.col("first"), radius))
    star = held.filter("tied AND fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    x = held.filter("NOT tied").select("grid", "cell", F.col("fp").alias("x"))
    y = held.select(F.col("grid").alias("grid_y"), F.col("cell").alias("cell_y"), F.col("fp").alias("y"), "tied")
    met = (F.col("grid") == F.col("grid_y")) & (F.col("cell") == F.col("cell_y")) & (F.col("tied") | (F.col("x") < F.col("y")))
    others = x.join(y, met & near(F.col("x"), F.col("y"), radius)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return star.unionByName(others).distinct()


def with_similar(found: DataFrame, texts: DataFrame, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(node, component) of the links found and those of texts (id, fp, text) with so large a share of equal shingles."""
    sets = materialize(similar.shingle_sets(texts, shingle, share), "sets")
    cells = materialize(similar.shared_cells(sets, share), "cells")
    found = materialize(found.unionByName(similar.first_links(cells, sets, texts, shingle, share)), "links")
    linked = materialize(components(found), "components")
    for search in (similar.next_links, similar.other_links):
        more = materialize(search(cells, sets, linked, texts, shingle, share), "links")
        if not more.isEmpty():
            both = more.unionByName(linked.select(F.col("component").alias("a"), F.col("node").alias("b")))
            linked = materialize(components(both), "components")
    return linked


def fingerprint_components(
    rows: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, share: tuple[int, int] | None = None
) -> DataFrame:
    """(fp, component_id, keep): of rows (doc_id, fp), for each distinct fp.

    share: a fraction; all texts whose shingles have that Jaccard similarity are linked
    too, for which rows has the columns id (unique) and text as well.

    component_id is the smallest doc_id reachable. keep: the doc_id that stands for the
    component lies under this fp (one fp in each component has it).
    """
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "fingerprints")
    found = links(nodes, groups_for(nodes.count(), radius), radius)
    linked = materialize(components(found), "components") if share is None else with_similar(found, rows.drop("doc_id"), shingle, share)
    named = linked.join(nodes, linked["node"] == nodes["fp"]).select("fp", "doc", "component")
    # Nulls count as larger than any doc_id; of equal ones the smaller fp stands for the component.
    order = F.struct(F.col("doc").isNull(), F.col("doc"), F.col("fp"))
    first = named.groupBy("component").agg(F.min("doc").alias("component_id"), F.min(order).getField("fp").alias("first_fp"))
    # Small beside nodes: only fingerprints that have links.
    linked = named.select("fp", "component").join(first, "component").select("fp", "component_id", "first_fp")
    linked = materialize(linked, "linked")
    return nodes.join(linked, "fp", "left").select(
        "fp",
        F.when(F.col("first_fp").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("first_fp").isNull() | (F.col("first_fp") == F.col("fp"))).alias("keep"),
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": [signed(fingerprint(t)) for t in utf8(batch.column(1))]}

    held = materialize(map_batches(documents(docs), ["doc_id", "text"], rows, "doc_id long, fp long"), "rows")
    found = fingerprint_components(held, radius).select("fp", "component_id")
    # Fingerprints with more than 1/HOT of all rows, at most HOT, meet a list; so no task has all rows of one.
    total = held.count()
    hot = [r["fp"] for r in held.groupBy("fp").count().filter(F.col("count") * HOT > total).collect()]
    if not hot:
        return held.join(found, "fp").select("doc_id", "fp", "component_id")
    few = F.broadcast(found.filter(F.col("fp").isin(hot)))
    both = held.filter(F.col("fp").isin(hot)).join(few, "fp").unionByName(held.filter(~F.col("fp").isin(hot)).join(found, "fp"))
    return both.select("doc_id", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, share: tuple[int, int] | None = None
) -> DataFrame:
    """The rows of docs, one for each component: the one with the smallest doc_id.

    Of rows with that doc_id and the component's first fingerprint the one with the least
    digest of its text stays, and of equal texts the one whose other columns (maps apart)
    have the least hash. Columns of docs keep their names and values.
    """
    names = docs.columns
    fp, row = unused(docs, "fp", "row")
    marked = materialize(with_fingerprints(docs, fp, shingle).withColumn(row, F.monotonically_increasing_id()), "marked")
    others = [f"`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    rows = marked.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(fp).alias("fp"),
        F.col(row).alias("id"),
        F.col("text").cast("string").alias("text"),
        F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.xxhash64(*others), F.col(row)).alias("order"),
    )
    first = fingerprint_components(rows.drop("order"), radius, shingle, share).filter("keep").select("fp", F.col("component_id").alias("first"))
    # Narrow columns only: of all rows with the right fingerprint and doc_id the first in order.
    narrow = rows.select("doc_id", "fp", "id", "order")
    kept = narrow.join(first, (narrow["fp"] == first["fp"]) & narrow["doc_id"].eqNullSafe(first["first"])).groupBy(first["fp"]).agg(F.min_by("id", "order").alias("kept"))
    kept = materialize(kept.select("kept"), "kept")
    return marked.join(kept, marked[row] == kept["kept"], "left_semi").select(*named(names))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
