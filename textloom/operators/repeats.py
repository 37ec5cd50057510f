"""Repeated runs of words, found by digests that are counted: no suffix is sorted.

A word's digest has 128 bits. The digest of n words comes from those of its first and its last
2^k words, the largest power of two up to n, so all runs of a length in a batch are made by a
few array operations. Equal digests are taken as equal runs (80 bits are compared where runs
are only counted, 128 where spans come out).

``repeat_counts`` sorts a part's digests and sends each ``BUCKETS``-th of their range as one packed
row, distinct digests once with their number; a bucket is merged by one task. Lengths go one
after the other, and the files of each exchange go before the next.

``repeated_spans`` sends, for each run of n words, only the least digest among the shorter runs in
it, which neighbouring runs mostly share. Two equal runs have that one at the same place, so
a run whose least digest stands nowhere else has no equal; only the others are compared whole.

Defined results: null and empty texts have no runs; documents may share a doc_id, or have none.
Words are cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.tables import materialize, release

BUCKETS = 4096
#: Rows of a batch whose words are made at once, and words whose digests are sorted at once.
ROWS, WORDS = 4096, 2_000_000
#: Keys of the two hashes of a word.
KEYS = "textloom repeats", "repeats textloom"


def word_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, digests of all words as rows of two numbers)."""
    cut = pc.ascii_split_whitespace(texts)
    words, parent = cut.flatten(), pc.list_parent_indices(cut)
    there = pc.not_equal(words, "")
    words, parent = words.filter(there).dictionary_encode(), parent.filter(there)
    names = words.dictionary.to_numpy(zero_copy_only=False)
    table = np.stack([pd.util.hash_array(names, hash_key=key, categorize=False) for key in KEYS], axis=1)
    return np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(texts)), table[words.indices.to_numpy(zero_copy_only=False)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = b * np.uint64(0x9FB21C651E98DF25)
        z = a * np.uint64(0x9E3779B97F4A7C15) + ((z << np.uint64(29)) | (z >> np.uint64(35)))
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        return z


def run_digests(words: np.ndarray, n: int) -> np.ndarray:
    """Digests of all runs of n words of one sequence; those over a document's end are the caller's to leave out."""
    out, k = words, 1
    while 2 * k <= n:
        out, k = _mixed(out[: max(0, len(out) - k)], out[k:]), 2 * k
    more = n - k
    return _mixed(out[: max(0, len(out) - more)], out[more:]) if more else out


def whole_runs(sizes: np.ndarray, n: int) -> np.ndarray:
    """Where in the sequence of all documents' words a run of n words begins that stays in its document."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    return np.flatnonzero(np.arange(len(ends)) + n <= ends)


# ---- how many positions repeat ----


def counted(digest: np.ndarray, extra: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of digest and extra bits in order, with how often each occurs."""
    order = np.argsort(digest, kind="stable")
    d, e = digest[order], extra[order]
    same = d[1:] == d[:-1]
    if (same & (e[1:] != e[:-1])).any():
        order = np.lexsort((extra, digest))
        d, e = digest[order], extra[order]
        same = (d[1:] == d[:-1]) & (e[1:] == e[:-1])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), dtype=bool), ~same]))
    n = np.diff(first, append=len(d)) if times is None else np.add.reduceat(times[order], first) if len(first) else times
    return d[first], e[first], n


def packed(d: np.ndarray, e: np.ndarray, n: np.ndarray) -> bytes:
    """Columns byte by byte, digests as differences: what is mostly zero stands together, and the exchange's compression takes it away."""
    planes = lambda x: x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return planes(np.diff(d, prepend=np.uint64(0))) + planes(e) + planes(n.astype(np.int64))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(blob) // 18
    m = np.frombuffer(blob, dtype=np.uint8)
    column = lambda at, width, kind: np.ascontiguousarray(m[at * size : (at + width) * size].reshape(width, size).T).view(kind).ravel()
    return np.cumsum(column(0, 8, "<u8"), dtype=np.uint64), column(8, 2, "<u2"), column(10, 8, "<i8")


def _sorted_runs(n: int):
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(held)
        d, e, times = counted(both[:, 0], both[:, 1].astype(np.uint16))
        # Buckets are ranges of the digests.
        cuts = np.searchsorted(d >> np.uint64(52), np.arange(BUCKETS + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = [packed(d[a:b], e[a:b], times[a:b]) for a, b in zip(cuts[some], cuts[some + 1], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                sizes, words = word_digests(batch.column(0).slice(k, ROWS))
                held.append(run_digests(words, n)[whole_runs(sizes, n)])
                size += len(held[-1])
                if size >= WORDS:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one group of buckets how many positions have a run that occurs more than once; each bucket's rows stand together."""
    bucket, held, total = None, [], 0

    def positions() -> int:
        if not held:
            return 0
        d, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
        n = counted(d, e, n)[2]
        return int(n[n > 1].sum())

    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != bucket:
                total, bucket, held = total + positions(), b, []
            held.append(unpacked(blob.as_py()))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([total + positions()], pa.int64())], names=["positions"])


def repeat_counts(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(n, positions): at how many positions a run of n words begins that occurs more than once; lengths without any run are left out."""
    spark, out = docs.sparkSession, []
    texts = docs.select("text").filter("text IS NOT NULL")
    for n in lengths:
        sent = texts.mapInArrow(_sorted_runs(n), "bucket int, runs binary")
        each = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "positions long")
        if (positions := each.agg(F.sum("positions")).first()[0]) is not None:
            out.append((n, positions))
        release(spark)
    return spark.createDataFrame(out, "n int, positions long")


# ---- spans ----


def least_digests(digests: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the first of the least among so many digests from there on."""
    n = len(digests) - width + 1
    # The least of a power of two from each place, doubled; two of them cover the width.
    at, k = np.arange(len(digests)), 1
    lesser = lambda a, b: np.where(digests[b] < digests[a], b, a)
    while 2 * k <= width:
        at, k = lesser(at[: len(at) - k], at[k:]), 2 * k
    return lesser(at[:n], at[width - k :][:n])


def _anchors(least: int):
    """(h1, h2, id, at, low, high): the least digest of runs of half the length, where it stands, and the starts low to high of the runs of least words that have it."""
    short = (least + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                sizes, words = word_digests(part.column(1))
                starts = whole_runs(sizes, least)
                if not len(starts):
                    continue
                digests = run_digests(words, short)
                at = least_digests(digests[:, 0], least - short + 1)[starts]
                doc = np.repeat(np.arange(len(sizes)), sizes)[starts]
                first = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
                begin = np.flatnonzero(first)
                base = (np.cumsum(sizes) - sizes)[doc[begin]]
                last = np.append(begin[1:], len(at)) - 1
                d, ids = digests[at[begin]].view(np.int64), part.column(0).to_numpy(zero_copy_only=False)
                columns = [d[:, 0], d[:, 1], ids[doc[begin]], at[begin] - base, starts[begin] - base, starts[last] - base]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "id", "at", "low", "high"])

    return run


def _runs_of(least: int):
    """(h1, h2, id, pos) of the runs that begin in a document's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                sizes, words = word_digests(part.column(1))
                ids, base = part.column(0).to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
                digests = run_digests(words, least).view(np.int64)
                ranges = part.column(2).flatten()
                doc = pc.list_parent_indices(part.column(2)).to_numpy(zero_copy_only=False)
                low, high = (ranges.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                each = np.repeat(np.arange(len(low)), high - low + 1)
                pos = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                d = digests[base[doc[each]] + pos]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (d[:, 0], d[:, 1], ids[doc[each]], pos)], names=["h1", "h2", "id", "pos"])

    return run


def _several(rows: DataFrame) -> DataFrame:
    """The rows whose digest another row has too."""
    n = F.count("*").over(Window.partitionBy("h1", "h2"))
    return rows.withColumn("textloom_n", n).filter("textloom_n > 1").drop("textloom_n")


def repeated_spans(docs: DataFrame, least: int) -> DataFrame:
    """(id, doc_id, start, stop): the longest spans of a document all of whose runs of least words stand elsewhere too."""
    spark = docs.sparkSession
    texts = materialize(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text").filter("text IS NOT NULL"), "texts")
    anchors = texts.select("id", "text").mapInArrow(_anchors(least), "h1 long, h2 long, id long, at long, low long, high long")
    ranges = materialize(_several(anchors).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")
    release(spark)
    met = texts.select("id", "text").join(ranges, "id").select("id", "text", "ranges")
    runs = _several(met.mapInArrow(_runs_of(least), "h1 long, h2 long, id long, pos long")).select("id", "pos")
    places = runs.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    p = F.col("p")
    begins = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1), F.lit(-2)) != x - 1)
    ends = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1), F.lit(-2)) != x + 1)
    spans = places.select("id", F.inline(F.arrays_zip(begins.alias("start"), ends.alias("stop"))))
    return spans.join(texts.select("id", "doc_id"), "id").select("id", "doc_id", "start", (F.col("stop") + least).alias("stop"))
