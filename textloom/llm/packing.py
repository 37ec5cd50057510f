"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its partition as they come. A document is its
byte-level BPE ids and one end id. Whole windows are cut off a long document first;
what is left, r ids, is placed into the fill level h (h = 0: a new window) with
h + r <= window that minimises the sum of squared counts of partially filled windows
over all levels. The counts stand in a level array; moving a window from h to h + r
changes the sum by 2 * (N[h + r] - N[h]) + 2, or 1 - 2 * N[h] when it becomes full,
so the best level is one vectorised argmin over the array.

Documents may be cut freely, so when the partition ends the partially filled windows
are levelled: the emptiest are poured, cut where needed, into the fullest until at
most one window of the partition is not full.

Memory is bounded by the open windows of one partition, which hold (document, start,
length) triples, and by the ids of their pieces, less than a window of each document:
whole windows leave at once, and a document is forgotten with its last piece.

Defined results: a null or empty text is its end id alone. Repeated rows are packed
apart. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from textloom.llm.common import documents, parts_of, read_table

WINDOW, END_ID = 2048, 1
#: Words whose ids a worker remembers; more are encoded anew each time.
CACHE_WORDS = 60_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """The ids of a byte-level BPE tokenizer file, as little-endian 32-bit words, by a cache of words.

    A space between two characters that are not white space always begins a new
    pre-token, so what stands between such spaces can be encoded on its own. Words that
    the cache lacks are joined and encoded in one call, and the ids are cut by the
    tokens' byte lengths.
    """

    def __init__(self, path: str):
        import public_tokenizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.parts = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[str, bytes] = {}

    @functools.cached_property
    def whole(self) -> Tokenizer:
        """The tokenizer itself, read only if a text holds one of its special tokens."""
        return Tokenizer.from_file(self.path)

    SAFE = re.compile(r"(?<=\S)(?= \S)")
    RUN = re.compile(r"\s\s")

    def split(self, text: str) -> list[str]:
        if self.RUN.search(text) or text[:1] == " ":
            return self.SAFE.split(text)
        words = text.split(" ")
        return [words[0], *[" " + w for w in words[1:]]] if len(words) > 1 else words

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if self.special and self.special.search(t) else self.split(t) for t in texts]
        cache = self.cache
        missing: dict[str, bytes] = {}
        for words in parts:
            if words is not None:
                missing.update(dict.fromkeys(w for w in words if w not in cache))
        missing.pop("", None)
        self._fill(missing)
        cache[""] = b""
        # As many as there is room for, so that a worker never holds more.
        room = max(0, CACHE_WORDS - len(cache))
        cache.update(islice(missing.items(), room))
        get = missing.get if len(missing) > room else None
        out = []
        for text, words in zip(texts, parts, strict=True):
            if words is None:
                out.append(np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            elif get is None:
                out.append(b"".join([cache[w] for w in words]))
            else:
                out.append(b"".join([cache[w] if w in cache else get(w) for w in words]))
        return out

    def _fill(self, missing: dict[str, bytes]) -> None:
        """Encode the words, each of which begins at a safe space or at a text's start."""
        spaced = [w for w in missing if w[0] == " " and not w[-1].isspace()]
        for w in missing.keys() - set(spaced):
            missing[w] = np.asarray(self.parts.encode_ordinary(w), dtype="<u4").tobytes()
        for k in range(0, len(spaced), 20_000):
            some = spaced[k : k + 20_000]
            ids = np.asarray(self.parts.encode_ordinary("".join(some)), dtype="<u4")
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum([len(w.encode()) for w in some])
            cuts = np.searchsorted(ends, wanted) + 1
            raw, a = ids.tobytes(), 0
            if not (ends[cuts - 1] == wanted).all():
                raise AssertionError("a token crosses a word's end")
            for w, b in zip(some, (cuts * 4).tolist(), strict=True):
                missing[w] = raw[a:b]
                a = b


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SumOfSquares:
    """Windows of one partition; a piece is (document, start, length)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window, dtype=np.int64)  # N[h]: open windows filled to h; N[0] stays 0
        self.open: dict[int, list[int]] = defaultdict(list)
        self.pieces: dict[int, list[tuple[int, int, int]]] = {}
        self.made = 0

    def _new(self) -> int:
        self.pieces[self.made] = []
        self.made += 1
        return self.made - 1

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Place a document; gives the windows that are full now."""
        at = 0
        while length - at >= self.window:
            yield self.made, [(doc, at, self.window)]
            self.made += 1
            at += self.window
        if rest := length - at:
            yield from self._place(doc, at, rest)

    def _place(self, doc: int, at: int, rest: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        n, counts = self.window, self.counts
        levels = n - rest + 1  # h = 0 .. n - rest
        change = np.empty(levels, dtype=np.int64)
        change[: levels - 1] = 2 * counts[rest:] + 1  # what a window gains at h + rest < n
        change[levels - 1] = 0
        change[1:] += 1 - 2 * counts[1:levels]
        change[1:][counts[1:levels] == 0] = np.iinfo(np.int64).max
        # Of equal levels the fullest.
        h = levels - 1 - int(np.argmin(change[::-1]))
        if h:
            w = self.open[h].pop()
            counts[h] -= 1
        else:
            w = self._new()
        self.pieces[w].append((doc, at, rest))
        if h + rest == n:
            yield w, self.pieces.pop(w)
        else:
            counts[h + rest] += 1
            self.open[h + rest].append(w)

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Pour the emptiest windows into the fullest; gives all that are left."""
        left = [(h, w) for h in sorted(self.open) for w in self.open[h]]
        low, high = 0, len(left) - 1
        loose: list[tuple[int, int, int]] = []
        while low <= high:
            h, w = left[high]
            pieces = self.pieces.pop(w)
            while h < self.window and (loose or low < high):
                if not loose:
                    loose = self.pieces.pop(left[low][1])
                    low += 1
                doc, at, length = loose.pop()
                part = min(length, self.window - h)
                pieces.append((doc, at, part))
                h += part
                if part < length:
                    loose.append((doc, at + part, length - part))
            yield w, pieces
            high -= 1
        # What was poured out of a window and found no room left.
        while loose:
            pieces, h = [], 0
            while loose and h < self.window:
                doc, at, length = loose.pop()
                part = min(length, self.window - h)
                pieces.append((doc, at, part))
                h += part
                if part < length:
                    loose.append((doc, at + part, length - part))
            yield self.made, pieces
            self.made += 1


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece. sequence_id is the partition's number times 2**40 plus the window's."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    path = vocabulary or vocabulary_path()
    target = to_arrow_schema(_parse_datatype_string(SCHEMA))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 40
        packer = SumOfSquares(window)
        # (doc_id, ids in all, ids without a place yet, the first id held, ids from there on) of documents that are not placed as a whole.
        held: dict[int, list] = {}
        number = 0
        rows: list[tuple] = []

        def out(full) -> None:
            for w, pieces in full:
                offset = 0
                for doc, at, length in pieces:
                    name, total, _, first, raw = held[doc]
                    rows.append((name, at, length, zlib.crc32(raw[4 * (at - first) : 4 * (at - first + length)]), total, base + w, offset))
                    offset += length
                    held[doc][2] -= length
                    if not held[doc][2]:
                        del held[doc]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
            rows.clear()
            return made

        for batch in batches:
            for part in parts_of(batch, 500):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, raw in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    total = len(raw) // 4 + 1
                    held[number] = [doc_id, total, total, 0, raw + end]
                    out(packer.add(number, total))
                    if number in held and (first := total // window * window):
                        held[number][3:] = first, held[number][4][4 * first :]
                    number += 1
            if rows:
                yield batch_of()
        out(packer.finish())
        if rows:
            yield batch_of()

    return documents(docs).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
