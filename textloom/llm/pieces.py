"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

Texts become one flat numpy array of characters: a mark before each text that is not empty
and for each space. The array is cut into words wherever two neighbours stand side by side
in no piece of the vocabulary, as no merge can cross such a place; equal words are encoded
once. A round finds the rank of every pair of neighbours by a hash table of the
vocabulary's pairs, the least rank of each word by a segmented minimum, merges in each word
the leftmost pair of that rank, and compacts the arrays; words without a pair leave. Further
pairs of the same rank in a word are merged in the same round if they do not overlap and
no merge before them makes a pair of the same or a better rank, which is when one merge
after the other would give the same. Runs of marks, whose pieces all have one score, are cut
by a table made from the same rule. Characters without a piece become byte pieces.

``decode`` gathers the pieces' bytes from a flat table. One space at the start of a text,
that of the mark put before it, goes.

The vocabulary is read from the model file with the sentencepiece library on each worker;
encoding and decoding themselves are numpy. A batch holds ``BATCH_CHARS`` characters or one
text.

Defined results: a null or empty text has no ids and decodes to the empty text. The mark
(U+2581) in a text is decoded as a space, as the library does. Repeated rows get equal
results. Other columns are ignored by the query and carried along by ``encode_documents``.
An empty table gives no rows. Models with another normalisation than the identity, with
white space removed, user-defined pieces, or without byte pieces raise ValueError.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from textloom.llm.common import documents, map_whole, parts_of, read_table, unused, with_fields

MARK = "▁"
BATCH_CHARS = 1 << 20
#: Symbols are piece ids, and for characters without a piece this base and the code point.
BASE = 1 << 20
NEVER = np.int32(2**31 - 1)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pairs:
    """Pair of symbols -> piece, as an open-addressing table that is probed for many pairs at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._place(keys)
        while len(left):
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, at = left[stay], at[stay]
            at = np.where(self.keys[at] == keys[left], at, (at + 1) & (len(self.keys) - 1))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = (left.astype(np.int64) << 22) | right
        at = self._place(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


@dataclass(frozen=True)
class Vocabulary:
    pairs: Pairs
    rank: np.ndarray  # by piece, 0 for the best score; equal scores have equal ranks
    single: np.ndarray  # code point -> number of a character that occurs in pieces, 0 for all others
    symbol: np.ndarray  # by that number: its symbol
    joined: np.ndarray  # bits: whether two such characters are neighbours in some piece
    width: int
    byte_ids: np.ndarray
    runs: list[list[int]] | None  # how a run of so many marks is cut, if by a table
    surface: np.ndarray  # all pieces' bytes, marks as spaces
    offset: np.ndarray
    is_byte: np.ndarray
    digits: np.ndarray  # by piece: its id in decimal and a comma, zeros after it


def _run_table(names: dict[str, int], scores: dict[str, float], longest: int) -> list[list[int]] | None:
    """Ids for runs of 0 to 3 * longest marks, if marks alone have the vocabulary's worst scores, all equal, and runs repeat after the longest piece."""
    alone = [p for p in names if len(p) > 1 and not p.strip(MARK)]
    others = [p for p in names if len(p) > 1 and p.strip(MARK)]
    if not alone or len({scores[p] for p in alone}) > 1 or any(MARK * 2 in p or MARK in p[1:] for p in others):
        return None
    if MARK not in names or min(scores[p] for p in others) <= scores[alone[0]]:
        return None
    out = []
    for n in range(3 * longest + 1):
        parts = [MARK] * n
        while hit := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in names), -1) + 1:
            parts[hit - 1 : hit + 1] = [parts[hit - 1] + parts[hit]]
        out.append([names[p] for p in parts])
    whole = [names[MARK * longest]]
    return out if all(out[n] == whole + out[n - longest] for n in range(longest, len(out))) else None


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids, names, scores, texts = np.full(256, -1), {}, {}, []
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"" if model.is_control(i) else " ⁇ ".encode())
        elif model.is_unused(i):
            raise ValueError("unused pieces are not known here")
        else:
            names[piece], scores[piece] = i, model.get_score(i)
            texts.append(piece.replace(MARK, " ").encode())
    if (byte_ids < 0).any() or model.encode("ﬁ  x") != model.encode(f"ﬁ{MARK}{MARK}x") or model.decode(model.encode(" ﬁ  x ")) != " ﬁ  x ":
        raise ValueError("only models with byte pieces that leave texts as they are")
    order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    rank = np.full(size, NEVER, dtype=np.int32)
    for piece, i in names.items():
        rank[i] = order[scores[piece]]
    symbol_of = lambda s: names.get(s, BASE + ord(s) if len(s) == 1 else -1)
    keys, values = [], []
    for piece, i in names.items():
        for k in range(1, len(piece)):
            a, b = symbol_of(piece[:k]), symbol_of(piece[k:])
            if a >= 0 and b >= 0:
                keys.append((a << 22) | b)
                values.append(i)
    runs = _run_table(names, scores, max((len(p) for p in names if not p.strip(MARK)), default=0))
    if runs:  # pairs of marks are left to the table
        held = [(k, v) for k, v in zip(keys, values, strict=True) if texts[v].strip(b" ")]
        keys, values = map(list, zip(*held, strict=True))
    chars = sorted({c for p in names for c in p} | {MARK})
    number = {c: k + 1 for k, c in enumerate(chars)}
    single = np.zeros(0x110000, dtype=np.int16 if len(chars) < 2**15 else np.int32)
    single[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    width = len(chars) + 1
    joined = np.zeros(width * width, dtype=bool)
    for p in names:
        for a, b in zip(p, p[1:]):
            joined[number[a] * width + number[b]] = True
    joined[0] = False
    digits = np.zeros((size, len(str(size)) + 1), dtype=np.uint8)
    for i in range(size):
        text = f"{i},".encode()
        digits[i, : len(text)] = np.frombuffer(text, dtype=np.uint8)
    offset = np.cumsum([0, *map(len, texts)])
    is_byte = np.zeros(size, dtype=bool)
    is_byte[byte_ids] = True
    return Vocabulary(
        Pairs(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)), rank, single,
        np.array([0, *map(symbol_of, chars)], dtype=np.int32), joined, width, byte_ids.astype(np.int32), runs,
        np.frombuffer(b"".join(texts), dtype=np.uint8), offset, is_byte, digits,
    )


# ---- encoding ----


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, so many, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _merge(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merge rounds over words: flat symbols and each word's length give the same after all merges."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    word = np.arange(len(lengths))
    piece = np.full(len(symbols), -1, dtype=np.int32)
    last = np.cumsum(lengths) - 1
    if len(symbols) > 1:
        piece[:-1] = v.pairs.find(symbols[:-1], symbols[1:])
    piece[last] = -1
    ranks = np.where(piece >= 0, v.rank[piece], NEVER)
    while len(word):
        starts = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(ranks, starts)
        live = least != NEVER
        if not live.all():
            done.append((word[~live], symbols[np.repeat(~live, lengths)], lengths[~live]))
            keep = np.repeat(live, lengths)
            symbols, piece, ranks = symbols[keep], piece[keep], ranks[keep]
            word, lengths, least = word[live], lengths[live], least[live]
            if not len(word):
                break
        owner = np.repeat(np.arange(len(word)), lengths)
        at = np.flatnonzero(ranks == least[owner])
        # Of overlapping places every other one, from the left.
        new = np.ones(len(at), dtype=bool)
        new[1:] = np.diff(at) > 1
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        own, made, right = owner[at], piece[at], at + 1
        # The pairs that a merge makes with what stands beside it when its turn comes.
        first = np.cumsum(lengths)[own] - lengths[own]
        beside = np.where(at > first, symbols[np.maximum(at - 1, 0)], -1)
        touching = np.zeros(len(at), dtype=bool)
        touching[1:] = (at[1:] - at[:-1] == 2) & (own[1:] == own[:-1])
        beside[1:] = np.where(touching[1:], made[:-1], beside[1:])
        end = np.cumsum(lengths)[own] - 1
        after = np.where(right < end, symbols[np.minimum(right + 1, len(symbols) - 1)], -1)
        before_piece = np.where(beside >= 0, v.pairs.find(np.maximum(beside, 0), made), -1)
        after_piece = np.where(after >= 0, v.pairs.find(made, np.maximum(after, 0)), -1)
        bar = least[own]
        worse = lambda p: (p < 0) | (v.rank[p] > bar)
        unsafe = ~(worse(before_piece) & worse(after_piece))
        if unsafe.any():
            # A word's merges up to its first unsafe one.
            count = np.cumsum(unsafe) - unsafe
            head = np.ones(len(at), dtype=bool)
            head[1:] = own[1:] != own[:-1]
            base = count[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            go = count == base
            at, own, made = at[go], own[go], made[go]
        symbols[at] = made
        gone = np.zeros(len(symbols), dtype=bool)
        gone[at + 1] = True
        place = np.cumsum(~gone) - 1
        symbols, piece, ranks = symbols[~gone], piece[~gone], ranks[~gone]
        lengths = lengths - np.bincount(own, minlength=len(word))
        at = place[at]
        stops = np.cumsum(lengths)
        # Pairs are looked up anew only beside a merge.
        for spot, fits in ((at, at < stops[own] - 1), (at - 1, at > stops[own] - lengths[own])):
            here = spot[fits]
            piece[here] = v.pairs.find(symbols[here], symbols[here + 1])
            ranks[here] = np.where(piece[here] >= 0, v.rank[piece[here]], NEVER)
        ends = at[at == stops[own] - 1]
        piece[ends], ranks[ends] = -1, NEVER
    if not done:
        return symbols, lengths
    order = np.concatenate([w for w, _, _ in done])
    sizes, flat = np.concatenate([n for _, _, n in done]), np.concatenate([s for _, s, _ in done])
    turn = np.argsort(order)
    return flat[_spread((np.cumsum(sizes) - sizes)[turn], sizes[turn])], sizes[turn]


def _cut_runs(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marks inside words by the table."""
    mark = v.symbol[v.single[ord(MARK)]]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    same = symbols == mark
    begins = same.copy()
    begins[1:] &= ~(same[:-1] & (owner[1:] == owner[:-1]))
    start = np.flatnonzero(begins)
    group = np.cumsum(begins)[same] - 1
    size = np.bincount(group, minlength=len(start)) if len(start) else np.zeros(0, dtype=np.int64)
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return symbols, lengths
    longest = (len(v.runs) - 1) // 3
    keep, out = np.ones(len(symbols), dtype=bool), symbols.copy()
    for n in np.unique(size):
        ids = v.runs[n] if n < len(v.runs) else [v.runs[longest][0]] * ((n - longest) // longest) + v.runs[longest + (n - longest) % longest]
        for k in range(int(n)):
            here = start[size == n] + k
            if k < len(ids):
                out[here] = ids[k]
            else:
                keep[here] = False
    return out[keep], np.bincount(owner[keep], minlength=len(lengths))


def _words(v: Vocabulary, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words of flat characters; first: where a text begins."""
    number = v.single[points].astype(np.int64)
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = ~v.joined[number[:-1] * v.width + number[1:]]
    begins[first] = True
    starts = np.flatnonzero(begins)
    return starts, np.diff(np.append(starts, len(points)))


def _distinct(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words stand for all, each word's number among them); words are equal if all their characters are."""
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    place = (np.arange(len(points)) - np.repeat(starts, lengths)).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    code = np.add.reduceat(mixed * (place | np.uint64(1)), starts) + lengths.astype(np.uint64)
    _, some, number = np.unique(code, return_index=True, return_inverse=True)
    twin = some[number]
    same = lengths == lengths[twin]
    both = np.flatnonzero(same)
    at = _spread(starts[both], lengths[both])
    equal = points[at] == points[_spread(starts[twin[both]], lengths[both])]
    if not equal.all():
        same[both] = np.logical_and.reduceat(equal, np.cumsum(lengths[both]) - lengths[both])
    odd = np.flatnonzero(~same)  # equal codes of different words: each stands for itself
    number[odd] = len(some) + np.arange(len(odd))
    return np.concatenate([some, odd]), number


def encode(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): all texts' ids one after the other, and how many each has."""
    marked = [MARK + t if t else "" for t in texts]
    sizes = np.array([len(t) for t in marked], dtype=np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    if not len(points):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    points[points == 32] = ord(MARK)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    starts, lengths = _words(v, points, first)
    some, number = _distinct(points, starts, lengths)
    at = _spread(starts[some], lengths[some])
    single = v.single[points[at]]
    symbols = np.where(single > 0, v.symbol[single], BASE + points[at]).astype(np.int32)
    symbols, sizes_of = _merge(v, symbols, lengths[some])
    if v.runs:
        symbols, sizes_of = _cut_runs(v, symbols, sizes_of)
    symbols, sizes_of = _as_bytes(v, symbols, sizes_of)
    begin = np.cumsum(sizes_of) - sizes_of
    ids = symbols[_spread(begin[number], sizes_of[number])]
    # Each text's words: from the word that starts with it to the next text's.
    totals = np.concatenate([[0], np.cumsum(sizes_of[number])])
    heads = np.append(np.searchsorted(starts, first), len(starts))
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[sizes > 0] = np.diff(totals[heads])
    return ids, counts


def _as_bytes(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece as the pieces of their UTF-8 bytes."""
    odd = np.flatnonzero(symbols >= BASE)
    if not len(odd):
        return symbols, lengths
    point = symbols[odd] - BASE
    width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    many = np.ones(len(symbols), dtype=np.int64)
    many[odd] = width
    out = np.repeat(symbols, many)
    begin = (np.cumsum(many) - many)[odd]
    head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
    for k in range(4):
        has = width > k
        rest = point[has] >> (6 * (width[has] - 1 - k))
        out[begin[has] + k] = v.byte_ids[np.where(width[has] == 1, rest, np.where(k == 0, head[has] | rest, 0x80 | (rest & 0x3F)))]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return out, np.bincount(owner, weights=many, minlength=len(lengths)).astype(np.int64)


# ---- decoding ----


def _decoded(raw: bytes) -> bytes:
    """Valid UTF-8: each byte that does not belong to a character becomes U+FFFD."""
    out: list[bytes] = []
    while raw:
        try:
            raw.decode("utf-8")
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start], "\ufffd".encode()]
            raw = raw[e.start + 1 :]
    return b"".join([*out, raw])


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each text in UTF-8 from its ids."""
    sizes = (v.offset[1:] - v.offset[:-1])[ids]
    flat = v.surface[_spread(v.offset[ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    stops = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        raw = flat[ends[a] : ends[b]]
        # The first piece that has characters loses a space at its start; a byte piece does not.
        lead = next((k for k in range(a, b) if sizes[k]), b)
        if lead < b and not v.is_byte[ids[lead]] and raw[:1] == b" " and ids[lead] != 0:
            raw = raw[1:]
        out.append(raw if raw.isascii() else _decoded(raw))
    return out


def joined_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each text's ids in decimal, joined by commas."""
    rows = v.digits[ids]
    flat = rows[rows > 0].tobytes()
    ends = np.concatenate([[0], np.cumsum((v.digits > 0).sum(axis=1)[ids])])
    stops = np.concatenate([[0], np.cumsum(counts)])
    return [flat[ends[a] : max(ends[b] - 1, ends[a])] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


# ---- tables ----


def _groups(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    some: list[str | None] = []
    size = 0
    for t in texts:
        if some and size + len(t or "") > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with all its columns, the ids of each text (piece_ids) and what they decode to (piece_text)."""
    path, at, own = path or vocabulary_path(), docs.columns.index("text"), unused(docs, "piece_ids", "piece_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in (p for b in batches for p in parts_of(b, 256)):
            ids, texts = [], []
            for some in _groups(part.column(at).to_pylist(), BATCH_CHARS):
                flat, counts = encode(v, some)
                ids += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
                texts += [x.decode() for x in decode(v, flat, counts)]
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *own])

    return map_whole(docs, run, with_fields(docs, **dict(zip(own, (ArrayType(IntegerType()), StringType()), strict=True))))


def decode_table(rows: DataFrame, column: str = "piece_ids", path: str | None = None) -> DataFrame:
    """rows with piece_text, the text of the ids in a column; null ids have a null text."""
    path, at, (own,) = path or vocabulary_path(), rows.columns.index(column), unused(rows, "piece_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in (p for b in batches for p in parts_of(b, 256)):
            lists = part.column(at).to_pylist()
            flat = np.array([i for x in lists for i in x or ()], dtype=np.int64)
            texts = decode(v, flat, np.array([len(x or ()) for x in lists], dtype=np.int64))
            made = pa.array([None if x is None else t.decode() for x, t in zip(lists, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, own])

    return map_whole(rows, run, with_fields(rows, **{own: "string"}))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """SCHEMA: how many ids each text has, and digests of them and of what they decode to; the ids stay in the task."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in (p for b in batches for p in parts_of(b, 4096)):
            n, ids, texts = [], [], []
            for some in _groups(part.column(1).to_pylist(), BATCH_CHARS):
                flat, counts = encode(v, some)
                n += counts.tolist()
                ids += [hashlib.sha256(x).hexdigest() for x in joined_ids(v, flat, counts)]
                texts += [hashlib.sha256(x).hexdigest() for x in decode(v, flat, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).select("doc_id", F.col("text")).mapInArrow(run, SCHEMA)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
