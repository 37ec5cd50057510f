"""ISO base media containers: a writer for byte payloads and a reader of sample tables.

The reader walks nested boxes (32- and 64-bit sizes, boxes that reach to the end of
the file) and decodes the sample tables stsd, mdhd, stts, stss, stsc, stsz/stz2 and
stco/co64 of each track: codec, duration, sample sizes, and the byte range of every
keyframe, which ``describe_media`` stores as (offset, length). It never decodes a payload.

Defined results: a null text is an empty one, so its payload is 192 spaces. Equal
texts give equal stored bytes. A file that ends inside a box or table, lacks a table, or has
tables that disagree raises ValueError, and so does one with movie fragments (moof), whose
samples stand outside the sample tables and are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import documents, map_batches, read_table, utf8

FRAME = 192
#: Samples in a chunk and samples from one keyframe to the next.
CHUNK_SAMPLES, KEY_EVERY = 16, 8
SAMPLE_RATE = 48_000

# Boxes that hold other boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"udta"))

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string, codec string, duration double,"
    " n_samples long, n_keyframes long, keyframes array<struct<offset:long,length:long>>"
)


def pad(data: bytes) -> bytes:
    """data with spaces after it up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def write_media(payload: bytes, frame: int = FRAME) -> bytes:
    """A one-track file whose samples are the payload's frames, as unsigned 8-bit audio ("raw ")."""
    if not payload or len(payload) % frame:
        raise ValueError(f"the payload must be a positive multiple of {frame} bytes")
    n = len(payload) // frame
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    runs = ([(1, CHUNK_SAMPLES)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    wide = len(payload) >= 1 << 31
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks + bool(rest), dtype=np.uint64) * (CHUNK_SAMPLES * frame)
        keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
        entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, SAMPLE_RATE << 16))
        tables = (
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, frame)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
            full(b"stsz", struct.pack(">II", frame, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), starts.astype(">u8" if wide else ">u4").tobytes()),
        )
        length = n * frame
        big = length >= 1 << 32
        times = struct.pack(">QQIQ" if big else ">IIII", 0, 0, SAMPLE_RATE, length)
        media = box(
            b"mdia",
            full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=big),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0"),
            box(
                b"minf",
                full(b"smhd", bytes(4)),
                box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))),
                box(b"stbl", *tables),
            ),
        )
        where = struct.pack(">QQIIQ" if big else ">IIIII", 0, 0, 1, 0, length)
        track = box(
            b"trak", full(b"tkhd", where, struct.pack(">8xHHHH", 0, 0, 256, 0), MATRIX, bytes(8), version=big, flags=7), media
        )
        tail = struct.pack(">IH10x", 1 << 16, 256) + MATRIX + bytes(24) + struct.pack(">I", 2)
        return box(b"moov", full(b"mvhd", times, tail, version=big), track)

    size = len(moov(0))
    before = len(head) + size + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(before) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    offsets: np.ndarray
    durations: np.ndarray
    keys: np.ndarray

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """(first byte, length) of every sync sample in the file."""
        return [(int(self.offsets[k]), int(self.sizes[k])) for k in self.keys]


def boxes(data: bytes, at: int, end: int):
    """(kind, first byte of the body, end) of the boxes that stand side by side in data[at:end]."""
    while at < end:
        if at + 8 > end:
            raise ValueError("the file ends inside a box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("the file ends inside a box header")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} does not fit into what holds it")
        yield kind, body, at + size
        at += size


def table(data: bytes, body: int, kind: str, fields: int = 1, skip: int = 4) -> np.ndarray:
    """The entries of a counted table: a 32-bit count, then rows of so many fields."""
    count = struct.unpack_from(">I", data, body + skip)[0]
    return np.frombuffer(data, kind, count * fields, body + skip + 4).reshape(count, fields).astype(np.int64)


def read_tracks(data: bytes) -> list[Track]:
    """Walk the boxes and decode each track's sample tables."""
    tracks: list[dict] = []

    # Boxes inside boxes of any depth: those still to be walked, the innermost last.
    open_ = [boxes(data, 0, len(data))]
    while open_:
        kind, body, stop = next(open_[-1], (None, 0, 0))
        if kind is None:
            open_.pop()
        elif kind == b"moof":
            raise ValueError("movie fragments are not read")
        else:
            if kind == b"trak":
                tracks.append({})
            if kind in CONTAINERS:
                open_.append(boxes(data, body, stop))
            elif tracks:
                tracks[-1][kind] = (body, stop)
    try:
        return [_track(data, found) for found in tracks if b"stsd" in found]
    except KeyError as missing:
        raise ValueError(f"a track has no box {missing}") from missing
    except (struct.error, StopIteration) as broken:
        raise ValueError("a sample table ends too early") from broken


def _track(data: bytes, found: dict[bytes, tuple[int, int]]) -> Track:
    kind, _, _ = next(boxes(data, found[b"stsd"][0] + 8, found[b"stsd"][1]))
    mdhd = found[b"mdhd"][0]
    scale, length = struct.unpack_from(">20xIQ" if data[mdhd] else ">12xII", data, mdhd)
    if not scale:
        raise ValueError("a track has no time scale")
    if b"stsz" in found:
        size, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
        if size * count > len(data):
            raise ValueError("a sample lies outside the file")
        sizes = (
            np.full(count, size, dtype=np.int64)
            if size
            else np.frombuffer(data, ">u4", count, found[b"stsz"][0] + 12).astype(np.int64)
        )
    else:
        bits, count = struct.unpack_from(">3xBI", data, found[b"stz2"][0] + 4)
        at = found[b"stz2"][0] + 12
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (count + 1) // 2, at)
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:count].astype(np.int64)
        else:
            sizes = np.frombuffer(data, ">u1" if bits == 8 else ">u2", count, at).astype(np.int64)
    chunks = (table(data, found[b"co64"][0], ">u8") if b"co64" in found else table(data, found[b"stco"][0], ">u4"))[:, 0]
    runs = table(data, found[b"stsc"][0], ">u4", 3)
    if len(chunks) and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise ValueError("the runs of chunks are out of order")
    # A run holds from its first chunk up to the next run's.
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per_chunk.sum() != len(sizes):
        raise ValueError("the sample tables disagree on the number of samples")
    ahead = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = np.repeat(chunks - ahead[first] if len(sizes) else chunks[:0], per_chunk) + ahead
    times = table(data, found[b"stts"][0], ">u4", 2)
    if times[:, 0].sum() != len(sizes):
        raise ValueError("the sample tables disagree on the number of samples")
    keys = table(data, found[b"stss"][0], ">u4")[:, 0] - 1 if b"stss" in found else np.arange(len(sizes))
    if len(sizes) and ((offsets + sizes).max() > len(data) or offsets.min() < 0):
        raise ValueError("a sample lies outside the file")
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise ValueError("a keyframe is no sample")
    return Track(kind.decode("latin-1"), scale, length, sizes, offsets, np.repeat(times[:, 1], times[:, 0]), keys)


def read_payload(data: bytes, track: Track) -> bytes:
    """The bytes of the track's samples in order, taken by the sample tables."""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    stops = np.concatenate([cuts, [len(ends)]]) - 1
    return b"".join(data[track.offsets[a] : ends[b]] for a, b in zip(starts, stops, strict=True))


def media_row(text: bytes) -> tuple:
    stored = write_media(pad(text))
    (track,) = read_tracks(stored)
    payload = read_payload(stored, track)
    ranges = zlib.crc32(np.stack([track.offsets[track.keys], track.sizes[track.keys]], 1).astype("<u8").tobytes())
    seconds = track.duration / track.timescale
    feature = f"{track.codec.strip()};duration={seconds:.6f};samples={len(track.sizes)};keyframes={len(track.keys)};ranges={ranges:08x}"
    return (
        len(text),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-16:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        feature,
        track.codec.strip(),
        seconds,
        len(track.sizes),
        len(track.keys),
        (track.offsets[track.keys], track.sizes[track.keys]),
    )


def describe_media(docs: DataFrame) -> DataFrame:
    """Store every text as a media file and describe the file from its boxes; moves no rows."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def rows(batch: pa.RecordBatch) -> dict:
        *got, keys = zip(*[media_row(t) for t in utf8(batch.column(1))], strict=True)
        ends = np.cumsum([0, *(len(offsets) for offsets, _ in keys)])
        ranges = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*keys, strict=True)], ["offset", "length"])
        keyframes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ranges)
        return {"doc_id": batch.column(0), **dict(zip(names, [*map(list, got), keyframes], strict=True))}

    return map_batches(documents(docs), ["doc_id", "text"], rows, SCHEMA)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(read_table(spark, sf_dir, "documents"))
