"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary made of training texts. Texts are read in
lower case, their letters only, words apart. A text is compressed once with each
dictionary and gets the language of the smallest size; of equal ones that with more
training rows. Sizes are compared as they are: a text that is foreign to a short dictionary
gains as little from it as from a long foreign one, so any correction for a dictionary's
length would hand it texts of other languages. The margin is the share by which the
smallest size is below the second; a prediction under ``MIN_MARGIN`` is marked as not
accepted.

Training uses a bounded sample of the rows with a language whose fold is not held out:
``SAMPLE_ROWS`` rows a language on average and ``SAMPLE_TOTAL`` rows in all, picked by a
hash of doc_id, of each at most ``SAMPLE_CHARS`` characters. All languages in the sample
are learned, and their dictionaries share ``DICTIONARY_TOTAL`` bytes. Predictions read the
whole text and nothing else.

Defined results: a text that is null, empty or without a letter is "und" with score 0
and not accepted; so is every text when no language could be learned. With one language
the score is 1. A null doc_id is neither held out nor learned from. Other columns are
ignored by the query and carried along by ``predict_languages``, whose own columns get
other names where docs has theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import map_whole, parts_of, read_table, unused, with_fields

SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS = 200, 100_000, 2_000
DICTIONARY_BYTES, DICTIONARY_TOTAL, LEVEL = 112 << 10, 56 << 20, 9
MIN_MARGIN = 0.01
#: A margin that gives a score of one half.
HALF_MARGIN = 0.02
UNDETERMINED = "und"

NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text in lower case with one space for all that stands between letters."""
    return NO_LETTERS.sub(" ", text.lower()).strip()


def fold(column: str = "doc_id", folds: int = 4):
    """crc32 of doc_id as text, modulo folds; null for a null doc_id."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Some texts of each language, the most frequent first, in the order of a hash of doc_id."""
    known = docs.filter(F.col("lang").isNotNull() & (fold() != 2))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total + 1).collect()}
    if not counts:
        return {}
    scale = 1 << 30
    picked = known.filter("text IS NOT NULL").select(
        F.col("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(scale)).alias("mark"), F.col("doc_id"), F.substring("text", 1, chars).alias("text")
    )
    if len(counts) > total:  # as many values as rows to learn from: all rows alike
        picked = picked.filter(F.col("mark") <= int(scale * total / known.count()))
    else:
        each = min(rows, total / len(counts))
        limits = docs.sparkSession.createDataFrame([(k, min(scale, int(scale * each / n) + 1)) for k, n in sorted(counts.items())], "lang string, most int")
        picked = picked.join(F.broadcast(limits), "lang").filter(F.col("mark") < F.col("most"))
    # About so many texts as total says at most, whatever the input.
    out: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(picked.select("lang", "mark", "doc_id", "text").collect(), key=lambda r: (r["lang"], r["mark"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: v for k, v in out.items() if v}


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def learn(sample: dict[str, list[str]], most: int = DICTIONARY_BYTES, total: int = DICTIONARY_TOTAL) -> dict[str, bytes]:
    """The dictionaries of the sample's languages, its texts with letters one after the other."""
    texts = {k: [x for x in (letters(t).encode() for t in v) if x] for k, v in sample.items()}
    texts = {k: v for k, v in texts.items() if v}
    size = min(most, total // max(len(texts), 1))
    return {k: b" ".join(v)[:size] for k, v in texts.items()}


class Compressors:
    def __init__(self, learned: dict[str, bytes]):
        self.names = list(learned)
        self.made = [compressor(x) for x in learned.values()]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        raw = letters(text or "").encode()
        if not raw or not self.made:
            return UNDETERMINED, 0.0, False
        if len(self.made) == 1:
            return self.names[0], 1.0, True
        sizes = [len(c.compress(raw)) for c in self.made]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.names[best], round(margin / (margin + HALF_MARGIN), 6), margin >= MIN_MARGIN


def predict_languages(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """docs with all its columns and lang_pred, lang_score, accepted after them; moves no rows."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(learned)  # DICTIONARY_TOTAL bytes at most
    own = unused(docs, "lang_pred", "lang_score", "accepted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(held.value)
        for part in (p for whole in batches for p in parts_of(whole)):
            name, score, sure = zip(*map(compressors.predict, part.column(at).to_pylist()), strict=True)
            made = [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *own])

    return map_whole(docs, run, with_fields(docs, **dict(zip(own, ("string", "double", "boolean"), strict=True))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    found = predict_languages(docs.select("doc_id", "text"), learn(training_sample(docs)))
    held_out = F.coalesce(fold() == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "accepted")
