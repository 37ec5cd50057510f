"""Spelling candidates within a number of edits, and known phrases.

Two words within e edits (insertions, deletions, substitutions) have a variant in common that
each becomes by deleting e characters at most. Variants of the vocabulary and of the words
sought meet in one join, and the distance is computed for what meets. The number of variants
grows with a word's length, so vocabulary words longer than ``LONG`` are cut into e + 1
pieces instead, one of which an e-edit neighbour holds unchanged, at most e places away.

Defined results: a word is no candidate of itself; null and empty words have none; repeated
words count once. Distances are between code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

LONG = 24


def deletions(word: Column, edits: int) -> Column:
    """All that is left of a word without any 0 to edits of its characters, each once."""
    def shorter(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    out = last = F.array(word)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        out = F.array_union(out, last)
    return out


def pieces(word: Column, edits: int) -> Column:
    """(part, at, piece): a word in edits + 1 parts of even length, with the place where each begins."""
    n = F.length(word)
    cut = lambda k: F.floor(n * k / (edits + 1)).cast("int")
    return F.array(*[F.struct(F.lit(k).alias("part"), cut(k).alias("at"), F.substring(word, cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")) for k in range(edits + 1)])


def windows(word: Column, edits: int) -> Column:
    """(size, part, piece): what each part of a vocabulary word of a length near this one's may look like here."""
    n, out = F.length(word), []
    for more in range(-edits, edits + 1):
        size = n + more
        for k in range(edits + 1):
            a, b = (F.floor(size * i / (edits + 1)).cast("int") for i in (k, k + 1))
            for shift in range(-edits, edits + 1):
                at = a + shift
                fits = (at >= 0) & (at + b - a <= n)
                out.append(F.when(fits, F.struct(size.alias("size"), F.lit(k).alias("part"), F.substring(word, at + 1, b - a).alias("piece"))))
    return F.array_distinct(F.filter(F.array(*out), lambda s: s.isNotNull()))


def candidates(words: DataFrame, vocabulary: DataFrame, edits: int = 2) -> DataFrame:
    """(word, suggestion, distance) of the vocabulary's words within so many edits of each word."""
    sought = words.select("word").filter("word <> ''").distinct()
    held = vocabulary.select(F.col("word").alias("suggestion")).filter("word <> ''").distinct()
    size = F.length("suggestion")
    short = sought.filter(F.length("word") <= LONG + edits).select("word", F.explode(deletions(F.col("word"), edits)).alias("variant"))
    met = short.join(held.filter(size <= LONG).select("suggestion", F.explode(deletions(F.col("suggestion"), edits)).alias("variant")), "variant")
    long_words = sought.filter(F.length("word") > LONG - edits).select("word", F.inline(windows(F.col("word"), edits)))
    cut = held.filter(size > LONG).select("suggestion", size.alias("size"), F.inline(pieces(F.col("suggestion"), edits)))
    also = long_words.join(cut, ["size", "part", "piece"])
    pairs = met.select("word", "suggestion").unionByName(also.select("word", "suggestion")).filter("word <> suggestion").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "suggestion", edits)).filter("distance >= 0")


def best(words: DataFrame, vocabulary: DataFrame, k: int = 3, edits: int = 2) -> DataFrame:
    """(word, suggestion, distance, rank): each word's k nearest candidates; vocabulary (word, freq): of equal distances the more frequent first."""
    from pyspark.sql.window import Window

    freq = vocabulary.groupBy(F.col("word").alias("suggestion")).agg(F.sum("freq").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("freq"), "suggestion"))
    found = candidates(words, vocabulary, edits).join(freq, "suggestion").withColumn("rank", rank)
    return found.filter(F.col("rank") <= k).select("word", "suggestion", "distance", "rank")


def known_phrases(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Those rows of phrases (phrase, ...) that stand in known (phrase), whatever their case and white space."""
    plain = lambda c: F.lower(T.trim(F.regexp_replace(c, r"\s+", " ")))
    held = known.select(plain(F.col("phrase")).alias("textloom_plain")).distinct()
    return phrases.join(held, plain(F.col("phrase")) == F.col("textloom_plain"), "left_semi")
