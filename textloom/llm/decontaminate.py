"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur in a document with up to e = floor(n * rate)
edits (insertions, deletions, substitutions). It is split into e + 1 pieces; an
occurrence with at most e edits leaves at least one piece whole. One Aho-Corasick
automaton finds every exact piece hit in a document; around each hit the window in
which the item can end is verified with Myers' bit-parallel distance, which gives
the smallest number of edits over all substrings of the window. Every hit is
verified (windows that overlap are merged first), so no occurrence is lost.

Item and text are compared as lower-cased words: ASCII punctuation and white space
count as one space. Items are searched in blocks of a bounded number of characters
(``block_chars``), each block against all documents; with more items there are more
passes, not larger automata. The driver holds one block at a time and hands it on as a
broadcast of that bounded size; the documents that a block's items leave are written before
the next one comes.

Defined results: null and empty texts match nothing; items without words are left
out; a repeated item reports under each of its ids, and one with a null id under a null
id; repeated document rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WORD_BYTES, documents, map_batches, map_whole, materialize, parts_of, read_table

ERROR_RATE = 0.08
#: Characters of items whose pieces one automaton holds.
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, distance int, item_chars int, end_char long"


def normal(text: str | None) -> str:
    """Lower-cased words joined by single spaces."""
    return b" ".join((text or "").lower().encode().translate(WORD_BYTES).split()).decode()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): errors + 1 pieces of nearly equal length that make up the item."""
    n, k = len(item), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def myers(peq: dict[str, int], n: int, text: str, most: int) -> tuple[int, int] | None:
    """(fewest edits, end) of the pattern against any substring of text, the first such end; none above most."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, at = most + 1, -1
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # A match may start anywhere, so no carry comes in from the left.
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
            if not best:
                break
    return (best, at) if at >= 0 else None


class PieceIndex:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, t, int(len(t) * rate), masks(t)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors, _) in enumerate(self.items):
            for start, piece in pieces(text, errors):
                found[piece].append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, item length, end in text) of each item that occurs, with its best place."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (length, where) in self.automaton.iter(text):
            begin = end + 1 - length
            for k, start in where:
                errors, n = self.items[k][2], len(self.items[k][1])
                left = begin - start - errors
                windows[k].append((max(0, left), min(len(text), begin - start + n + errors)))
        out = []
        for k, spans in windows.items():
            item, pattern, errors, peq = self.items[k]
            best = None
            for a, b in merged(spans):
                if (hit := myers(peq, len(pattern), text[a:b], errors)) and (best is None or hit[0] < best[0]):
                    best = hit[0], a + hit[1]
            if best:
                out.append((item, best[0], len(pattern), best[1]))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """Lists of (item id, normalised text) with about so many characters each, one after the other."""
    held, chars, made = [], 0, 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if not (text := normal(r[1])):
            continue
        held.append((r[0], text))
        chars += len(text)
        if chars >= most:
            yield held
            held, chars, made = [], 0, made + 1
    if held or not made:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document row and each item that occurs in it with at most floor(n * rate) edits."""
    docs = documents(docs)

    def search(block: list[tuple[int, str]]) -> DataFrame:
        held, made = docs.sparkSession.sparkContext.broadcast(block), []

        def rows(batch: pa.RecordBatch) -> dict:
            if not made:
                made.append(PieceIndex(held.value, rate))
            out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for hit in made[0].matches(normal(text)) if made[0].items and text else ():
                    for name, value in zip(out, (doc, *hit), strict=True):
                        out[name].append(value)
            return out

        return map_batches(docs, ["doc_id", "text"], rows, SCHEMA)

    return reduce(DataFrame.unionByName, map(search, blocks(items, block_chars)))


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all columns, in which no item occurs; moves no rows between tasks."""
    at = docs.columns.index("text")

    def clean(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(held.value, rate)
            for batch in (p for whole in batches for p in parts_of(whole)):
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not (index.items and t and index.matches(normal(t))) for t in texts], pa.bool_()))

        return map_whole(docs, run, docs.schema)

    out = None
    for block in blocks(items, block_chars):
        out = clean(docs if out is None else materialize(out, "clean"), block)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
