"""Vector bin packing of documents into shards: bytes, tokens and rows jointly.

Equal texts form a group, and a group goes to one shard whole unless it is hot: a group
of more than ``HOT_ROWS`` rows and more than 1/64 of all bytes or rows, an eighth of a
shard, is dealt by a hash of a number of each row's own into chunks of 1/1024;
doc_id has no part in it, so rows without one or with one in common are dealt as well. In
a table of any size a group of fewer rows stays together, however large its texts. A unit (group or chunk) has a demand vector (bytes, tokens, rows)
in shares of the totals, and goes to the shard where the dot product of the demand
with the residual capacity is highest, largest units first.

The greedy runs three times. Large units (over 1/4096 of any total; there are at most
12,288 of them) come first, on the driver. The rest is dealt into buckets of a bounded
number of units, each a small instance of the same problem with its share of what the
large units left; a bucket's shards end about a small unit apart, and turning the order
of the shards by bucket keeps these remainders from adding up. An eighth of the units,
and about 2,000 at most, picked by hash, wait for the end and are placed on the driver
into the capacity that is really left then, which evens the shards out.

slot: rows of a shard are numbered within 32 or more hash parts of it, and the parts
start where the one before ends, so no shard is sorted in one task.

Defined results: a null text has size 1, the checksum of the empty text, and is in
one group with the empty text. Repeated rows each get a slot. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import documents, materialize, read_table

SHARDS = 8
#: A group of more than HOT_ROWS rows and over 1/HOT of all bytes or rows is dealt into chunks; a unit over 1/LARGE of a total is large.
HOT, HOT_ROWS, LARGE = 64, 256, 4096
#: A chunk is about 1/CHUNKS of the bytes or rows.
CHUNKS = 1024
#: Units in one bucket: on average no more than the one, and no fewer than the other where there are more buckets than one.
BUCKET_UNITS, LEAST_UNITS = 20_000, 500
#: Units that are placed last, on the driver: one in so many, and on average no more than so many.
LAST_SHARE, LAST_UNITS = 8, 2_000
PART_ROWS = 1_000_000

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def place(demand: np.ndarray, capacity: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shard of each unit: demand (n, 3) and capacity (shards, 3) in shares; capacity is used up in place.

    Units are taken in the given order; of shards that tie the first is taken. A shard
    that a unit would overfill in some dimension counts only if all would be.
    """
    out = np.empty(len(demand), dtype=np.int64)
    for i in order:
        d = demand[i]
        score = capacity @ d
        room = (capacity >= d - 1e-12).all(axis=1)
        best = int(np.argmax(np.where(room, score, -np.inf))) if room.any() else int(np.argmax(score))
        out[i] = best
        capacity[best] -= d
    return out


def largest_first(demand: np.ndarray, keys: list) -> np.ndarray:
    """Positions by the largest share, then by key."""
    return np.array(sorted(range(len(keys)), key=lambda i: (-demand[i].max(), keys[i])), dtype=np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """What is needed of each document; texts themselves do not move."""
    text = F.coalesce("text", F.lit(""))
    return documents(docs).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("body"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
    )


def sums_of_units() -> list:
    return [F.sum(c).alias(c) for c in ("size", "tokens", "rows")]


def assign(docs: DataFrame, shards: int = SHARDS, bucket_units: int = BUCKET_UNITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs."""
    spark = docs.sparkSession
    rows = materialize(rows_of(docs).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    sums = [*sums_of_units()[:2], F.count("*").alias("rows")]
    groups = rows.groupBy("body").agg(*sums)
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = np.array([total["size"], max(1, total["tokens"]), total["rows"]], dtype=float)
    # At most 2 * HOT groups can be so large, so the list is bounded.
    hot = groups.filter((F.col("size") * HOT > total["size"]) | (F.col("rows") * HOT > total["rows"])).filter(F.col("rows") > HOT_ROWS)
    chunks = {bytes(r["body"]): int(np.ceil(CHUNKS * max(r["size"] / whole[0], r["rows"] / whole[2]))) for r in hot.toLocalIterator()}
    chunk = F.lit(0)
    if chunks:
        held = spark.createDataFrame([(bytearray(b), n) for b, n in sorted(chunks.items())], "body binary, chunks int")
        rows = rows.join(F.broadcast(held), "body", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("row"), F.col("chunks"))).otherwise(0)
    rows = rows.withColumn("chunk", chunk.cast("int"))
    units = materialize(rows.groupBy("body", "chunk").agg(*sums), "shard-units")

    large = (F.col("size") * LARGE > total["size"]) | (F.col("tokens") * LARGE > int(whole[1])) | (F.col("rows") * LARGE > total["rows"])
    left = np.full((shards, 3), 1 / shards)

    def on_driver(some: list) -> list[tuple]:
        keys = [(bytes(r["body"]), r["chunk"]) for r in some]
        demand = np.array([[r["size"], r["tokens"], r["rows"]] for r in some], dtype=float).reshape(-1, 3) / whole
        placed = place(demand, left, largest_first(demand, keys))
        return [(bytearray(b), c, int(s)) for (b, c), s in zip(keys, placed, strict=True)]

    made = on_driver(units.filter(large).collect())  # at most 3 * LARGE units

    rest = units.filter(~large)
    n_rest = rest.count()
    late = F.pmod(F.xxhash64("chunk", "body"), F.lit(max(LAST_SHARE, n_rest // LAST_UNITS))) == 0
    buckets = max(1, min(64, n_rest // LEAST_UNITS), -(-n_rest // bucket_units))
    share = np.maximum(left, 0)
    share = share / np.maximum(share.sum(axis=0), 1e-300)  # of each dimension's rest, by shard

    def pack(table: pa.Table) -> pa.Table:
        keys = list(zip(table.column("body").to_pylist(), table.column("chunk").to_pylist(), strict=True))
        load = np.stack([table.column(c).to_numpy() for c in ("size", "tokens", "rows")], 1)
        d = load / np.maximum(load.sum(axis=0), 1)
        turn = table.column("bucket")[0].as_py() % shards
        names = (np.arange(shards) + turn) % shards
        found = names[place(d, share[names].copy(), largest_first(d, keys))]
        return pa.table({"shard": pa.array(found, pa.int32()), **{c: table.column(c) for c in ("body", "chunk", "size", "tokens", "rows")}})

    small = (
        rest.filter(~late)
        .withColumn("bucket", F.pmod(F.xxhash64("body", "chunk"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInArrow(pack, "shard int, body binary, chunk int, size long, tokens long, rows long")
    )
    small = materialize(small, "shard-plan")
    for r in small.groupBy("shard").agg(*sums_of_units()).collect():
        left[r["shard"]] -= np.array([r["size"], r["tokens"], r["rows"]]) / whole
    made += on_driver(rest.filter(late).collect())  # about LAST_UNITS at most
    plan = spark.createDataFrame(made, "body binary, chunk int, shard int").unionByName(small.select("body", "chunk", "shard"))
    assigned = rows.join(plan, ["body", "chunk"]).select("doc_id", "size", "text_crc32", "shard", "row")
    return with_slots(assigned, total["rows"])


def with_slots(assigned: DataFrame, n_rows: int) -> DataFrame:
    """Number each shard's rows from 0 without gaps, part by part."""
    parts = max(32, -(-n_rows // PART_ROWS))
    held = materialize(
        assigned.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "shard-assigned"
    )
    counts = sorted((r["shard"], r["part"], r["count"]) for r in held.groupBy("shard", "part").count().collect())
    starts, at, last = [], 0, None
    for shard, part, n in counts:
        at = 0 if shard != last else at
        starts.append((shard, part, at))
        at, last = at + n, shard
    # shards * parts rows, one for each million rows of input.
    begun = held.sparkSession.createDataFrame(starts, "shard int, part int, begin long")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "row")
    ranked = held.withColumn("rank", F.row_number().over(order))
    return ranked.join(F.broadcast(begun), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("rank") - 1).alias("slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
