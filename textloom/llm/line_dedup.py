"""Line dedup with sharded cuckoo filters over exact reference-count tables.

State (``LineIndex``): a reference-count table (key, docs) with one row per distinct line
key and the number of documents that hold it, and for each shard of the key space one row
with a cuckoo filter (16-bit fingerprints, buckets of four, two buckets a key) of the
shard's common keys, those in at least ``min_docs`` documents, beside the exact list of
these keys. Documents come in and go out again (``insert_documents``,
``delete_documents``): their keys' counts change, and the keys that thereby become common
or stop being so are put into or taken out of their shard's filter. A deletion undoes an
insertion in both.

Lookup: the documents' keys, each with the digest of its document's text, are dealt by
shard together with the shards' rows and sorted so that a shard's row comes first. A task
reads them as a stream and holds one shard at a time: a key that its filter rejects is
not common, one that passes is checked against the exact list. So neither filters nor
lists are ever gathered, whatever their number, and a key that the index lacks is not
common. Keys that make up more than 1/256 of all those of the documents, at most 256,
would crowd one shard; they are looked up in a list of their own. The common keys of each
text then meet the documents by the text's digest; texts that make up more than 1/256 of
all rows are salted.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Keys
and texts are told apart by 128-bit digests (MD5).

Defined results: a null or empty text is one empty line; an empty key is never
dropped; a document that loses all its lines keeps the empty text. A key counts once
for each row of the table, whatever its doc_id, so repeated rows count apart. Other
columns are ignored by the query and carried along by ``dedup_lines``, whose own columns
get other names where docs has theirs. Deleting documents that were never inserted takes
counts to nothing at most.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, map_whole, materialize, named, parts_of, read_table, unused, utf8, with_fields

MIN_DOCS = 10
SPACE = b" \t\n\x0b\x0c\r"
#: Common keys in one shard on average, and shards at least.
SHARD_KEYS, MIN_SHARDS = 2_048, 512
#: A key or text with more than 1/HOT of all is not left to one task.
HOT, SALTS = 256, 64

KEY = np.dtype("S16")


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def digest(key: bytes) -> bytes:
    """16 bytes, or none for the empty key."""
    return hashlib.md5(key, usedforsecurity=False).digest() if key else b""


# ---- cuckoo filters ----


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and both buckets of digests given as (n, 2) little-endian words."""
    low = keys[:, 1]
    prints = ((low >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    first = (low & np.uint64(buckets - 1)).astype(np.int64)
    return prints, first, first ^ _step(prints, buckets)


def _step(prints: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(prints) & np.uint64(buckets - 1)).astype(np.int64)


def as_words(digests: list[bytes] | bytes) -> np.ndarray:
    return np.frombuffer(digests if isinstance(digests, bytes) else b"".join(digests), dtype="<u8").reshape(-1, 2)


class CuckooFilter:
    """Insertions, deletions and lookups of 128-bit digests in 16-bit fingerprints."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        need = max(1, -(-capacity // 3))  # filled to three quarters at most
        self.table = np.zeros((1 << (need - 1).bit_length(), self.SLOTS), dtype=np.uint16)
        self.turn = 0

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        held = cls(1)
        held.table = np.frombuffer(raw, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        return held

    def insert(self, keys: np.ndarray) -> None:
        """Add digests (n, 2): all that find a free slot at once, the others by moving what is there."""
        prints, first, second = _split(keys, len(self.table))
        table, left = self.table, np.arange(len(keys))
        for where in (first, second):
            for slot in range(self.SLOTS):
                free = np.flatnonzero(table[where[left], slot] == 0)
                # One key for each bucket.
                _, lead = np.unique(where[left[free]], return_index=True)
                chosen = free[lead]
                table[where[left[chosen]], slot] = prints[left[chosen]]
                left = np.delete(left, chosen)
        for p, at in zip(prints[left].tolist(), second[left].tolist(), strict=True):
            for _ in range(self.KICKS):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = p
                    break
                self.turn += 1
                slot = self.turn % self.SLOTS
                p, table[at, slot] = int(table[at, slot]), p
                at ^= int(_step(np.array([p]), len(table))[0])
            else:
                raise OverflowError("the filter is full")

    def delete(self, keys: np.ndarray) -> None:
        """Take digests out that were put in before."""
        for p, a, b in zip(*[x.tolist() for x in _split(keys, len(self.table))], strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == p)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                raise KeyError("a digest that was never inserted")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = _split(keys, len(self.table))
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = len(keys)
        while True:
            made = cls(capacity)
            try:
                made.insert(keys)
                return made
            except OverflowError:
                capacity = 4 * len(made.table)


class Shard:
    """A shard's filter with the exact list of its keys, sorted and joined."""

    def __init__(self, filter_: bytes, keys: bytes):
        self.filter, self.keys = CuckooFilter.of_bytes(filter_), np.frombuffer(keys, dtype=KEY)

    def holds(self, digests: list[bytes]) -> np.ndarray:
        """Which digests are in: those that pass the filter and stand in the list."""
        out = self.filter.contains(as_words(digests))
        passed = np.flatnonzero(out)
        if len(passed):
            out[passed] = np.isin(np.array([digests[i] for i in passed], dtype=KEY), self.keys)
        return out

    def changed(self, come: list[bytes], go: list[bytes]) -> tuple[bytes, bytes]:
        """(filter, keys) after some digests came in and others went out; a filter that overflows is made anew, larger."""
        raw = self.keys.tobytes()
        keys = sorted({raw[i : i + 16] for i in range(0, len(raw), 16)} - set(go) | set(come))
        try:
            if go:
                self.filter.delete(as_words(go))
            if come:
                self.filter.insert(as_words(come))
        except OverflowError:
            self.filter = CuckooFilter.build(as_words(keys))
        return self.filter.table.tobytes(), b"".join(keys)


# ---- documents' keys ----


def line_pairs(docs: DataFrame) -> DataFrame:
    """(body, key, n, lead): for each text's digest the distinct keys of its lines, the empty key included.

    n: the number of rows with that text in a batch, which are one here; lead marks one of
    the keys, so that rows can be counted.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"body": [], "key": [], "n": [], "lead": []}
        for text, n in Counter(utf8(batch.column(0))).items():
            keys = {digest(k) for k in {line_key(x) for x in text.split(b"\n")}}
            out["key"] += keys
            out["body"] += [hashlib.md5(text, usedforsecurity=False).digest()] * len(keys)
            out["n"] += [n] * len(keys)
            out["lead"] += [True] + [False] * (len(keys) - 1)
        return out

    return map_batches(docs.select(F.col("text").cast("string").alias("text")), ["text"], rows, "body binary, key binary, n int, lead boolean")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.octet_length("key") > 0).groupBy("key").agg(F.sum("n").alias("docs"))


def line_counts(docs: DataFrame) -> DataFrame:
    """(key, docs): every distinct non-empty line key and the number of rows of docs that hold it."""
    return _counted(line_pairs(docs))


# ---- the index ----


@dataclass(frozen=True)
class LineIndex:
    """counts (key, docs) and filters (shard, filter, keys), both written tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def build_filters(common: DataFrame, shards: int) -> DataFrame:
    """(shard, filter, keys) of a table of common keys; shards without such a key have no row."""

    def build(table: pa.Table) -> pa.Table:
        keys = sorted(table.column("key").to_pylist())
        made = CuckooFilter.build(as_words(keys))
        return pa.table({"shard": table.column("shard")[:1], "filter": [made.table.tobytes()], "keys": [b"".join(keys)]}, schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("keys", pa.binary())]))

    return common.select("key", shard_of(F.col("key"), shards).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary, keys binary")


def index_of(counts: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
    """The index over a written table of counts."""
    common = counts.filter(F.col("docs") >= min_docs).select("key")
    shards = max(MIN_SHARDS, -(-common.count() // SHARD_KEYS))
    return LineIndex(counts, materialize(build_filters(common, shards), "cuckoo"), shards, min_docs)


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
    return index_of(materialize(line_counts(docs), "line-counts"), min_docs)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index after docs came in."""
    return _changed(index, docs, 1)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index after docs, inserted before, went out; keys that nobody holds go too."""
    return _changed(index, docs, -1)


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    more = line_counts(docs).select("key", (F.col("docs") * sign).alias("more"))
    both = index.counts.join(more, "key", "full_outer").select(
        "key", F.coalesce("docs", F.lit(0)).alias("old"), (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs")
    )
    both = materialize(both, "line-changes")
    counts = both.filter("docs > 0").select("key", "docs")
    was, now = F.col("old") >= index.min_docs, F.col("docs") >= index.min_docs
    if both.filter(now).count() > 4 * SHARD_KEYS * index.shards:
        return index_of(materialize(counts, "line-counts"), index.min_docs)
    moves = both.filter(was != now).select(shard_of(F.col("key"), index.shards).alias("shard"), "key", now.alias("come"))

    def update(held: pa.Table, moves: pa.Table) -> pa.Table:
        shard = (held if held.num_rows else moves).column("shard")[:1]
        state = (held.column("filter")[0].as_py(), held.column("keys")[0].as_py()) if held.num_rows else (CuckooFilter(1).table.tobytes(), b"")
        come, go = ([k for k, c in zip(moves.column("key").to_pylist(), moves.column("come").to_pylist(), strict=True) if c == want] for want in (True, False))
        raw, keys = Shard(*state).changed(come, go)
        made = pa.table({"shard": shard, "filter": [raw], "keys": [keys]}, schema=pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("keys", pa.binary())]))
        return made if keys else made.slice(0, 0)

    filters = index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(update, "shard int, filter binary, keys binary")
    return LineIndex(materialize(counts, "line-counts"), materialize(filters, "cuckoo"), index.shards, index.min_docs)


# ---- lookup ----


def _streamed(filters: DataFrame, pairs: DataFrame, shards: int) -> DataFrame:
    """(body, key) of the pairs whose key is common, by shard."""
    held = filters.select("shard", F.lit(0).alias("kind"), "filter", "keys", F.lit(None).cast("binary").alias("body"), F.lit(None).cast("binary").alias("key"))
    asked = pairs.select(shard_of(F.col("key"), shards).alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), F.lit(None).cast("binary").alias("keys"), "body", "key")
    dealt = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(numbers, prepend=number) != 0) | (kinds == 0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != number:
                    number, shard = numbers[a], None
                if kinds[a] == 0:
                    shard = Shard(batch.column(2)[a].as_py(), batch.column(3)[a].as_py())
                    a += 1
                if shard is None or a == b:
                    continue
                part = batch.slice(a, b - a)
                hits = pa.array(shard.holds(part.column(5).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(4).filter(hits), part.column(5).filter(hits)], names=["body", "key"])

    return dealt.mapInArrow(run, "body binary, key binary")


def common_lines(index: LineIndex, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(body, key), repeated rows included, of the pairs whose key is common; counts: those of the pairs."""
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = [bytes(r["key"]) for r in counts.filter(F.col("docs") * HOT > total).select("key").collect()]  # at most HOT
    solid = pairs.filter(F.octet_length("key") > 0).select("body", "key")
    if not hot:
        return _streamed(index.filters, solid, index.shards)
    listed = [F.lit(k) for k in sorted(hot)]
    common = [F.lit(bytes(r["key"])) for r in index.counts.filter(F.col("key").isin(listed) & (F.col("docs") >= index.min_docs)).select("key").collect()]
    found = _streamed(index.filters, solid.filter(~F.col("key").isin(listed)), index.shards)
    return found.unionByName(solid.filter(F.col("key").isin(common))) if common else found


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """docs with its text replaced by the kept lines, and the columns n_lines and n_dropped after the others.

    index: the reference counts and filters to go by; docs' own if there are none.
    """
    names, at = docs.columns, docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    pairs = materialize(line_pairs(docs), "line-pairs")
    counts = materialize(_counted(pairs), "line-counts")
    index = index or index_of(counts, min_docs)

    led = pairs.filter("lead")
    rows = led.agg(F.sum("n")).first()[0] or 0
    hot = [F.lit(bytes(r["body"])) for r in led.groupBy("body").agg(F.sum("n").alias("n")).filter(F.col("n") * HOT > rows).collect()]  # at most HOT
    body, salt, gone, lines, dropped = unused(docs, "body", "salt", "gone", "n_lines", "n_dropped")
    found = common_lines(index, pairs, counts).groupBy("body").agg(F.collect_set("key").alias(gone)).withColumnRenamed("body", body)
    marked = docs.withColumn(body, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    on = [body]
    if hot:
        spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        marked = marked.withColumn(salt, F.when(F.col(body).isin(hot), spread).otherwise(0))
        found = found.withColumn(salt, F.explode(F.when(F.col(body).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on = [body, salt]
    joined = marked.join(found, on, "left").select(*named(names), gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole)):
            out, total, less = [], [], []
            for text, held in zip(utf8(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                kept = all_ = text.split(b"\n")
                if held:
                    held = set(held)
                    kept = [x for x in all_ if digest(line_key(x)) not in held]
                    text = b"\n".join(kept)
                out.append(text)
                total.append(len(all_))
                less.append(len(all_) - len(kept))
            arrays = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(less, pa.int64())], names=[*batch.schema.names[:-1], lines, dropped])

    return map_whole(joined, run, with_fields(docs, **{lines: "long", dropped: "long"}))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def rows(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column(0),
            "n_lines": batch.column(1),
            "n_dropped": batch.column(2),
            "kept_sha256": [hashlib.sha256(t).hexdigest() for t in utf8(batch.column(3))],
        }

    return map_batches(dedup_lines(docs), ["doc_id", "n_lines", "n_dropped", "text"], rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The lines' keys and counts over all documents. A row's own number stands for it, as doc_id may repeat.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
k AS (SELECT r, doc_id, line, n, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM (SELECT DISTINCT r, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT k.doc_id AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.n) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.r, k.doc_id
"""
