"""Corpus statistics: tokens, vocabulary, n-grams, phrases, folding, contexts, language models.

A corpus is a table of documents (doc_id, text). Its token stream is (doc_id, pos, word);
positions order a document, (doc_id, pos) the corpus. N-grams stay within a document and,
where lines matter, within a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions import tokenize
from textloom.operators.tables import dense_ids, materialize, release

EOL, NUMBER, RARE = "<eol>", "<number>", "<rare>"


def with_words(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """(doc_id, words): the words of each document in order."""
    return docs.select("doc_id", (tokenize.whitespace(F.col("text")) if words is None else words).alias("words"))


def tokens(docs: DataFrame, words: Column | None = None) -> DataFrame:
    return with_words(docs, words).select("doc_id", F.posexplode("words").alias("pos", "word"))


def line_tokens(docs: DataFrame) -> DataFrame:
    """Tokens with an <eol> after each line."""
    line = F.transform(F.split("text", "\n"), lambda s: F.concat(tokenize.whitespace(s), F.array(F.lit(EOL))))
    return docs.select("doc_id", F.posexplode(F.flatten(line)).alias("pos", "word"))


def vocabulary(toks: DataFrame) -> DataFrame:
    """(word, freq, first_doc, first_pos)."""
    first = F.min(F.struct("doc_id", "pos"))
    return toks.groupBy("word").agg(F.count("*").alias("freq"), first.alias("first")).select(
        "word", "freq", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")
    )


def vocabulary_ids(toks: DataFrame) -> DataFrame:
    """The vocabulary with dense ids in first-seen order."""
    return dense_ids(vocabulary(toks), ["first_doc", "first_pos"])


def term_frequency(toks: DataFrame) -> DataFrame:
    return toks.groupBy("word").agg(F.count("*").alias("freq"))


def lookup_frequency(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, freq) of a table of words; 0 for those that never occur."""
    return words.join(vocab.select("word", "freq"), "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"))


def grams(n: int, words: Column) -> Column:
    """All runs of n words joined by spaces, in order."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngram_positions(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, ngram) of every n-gram."""
    return with_words(docs).select("doc_id", F.posexplode(grams(n, F.col("words"))).alias("pos", "ngram"))


def ngrams(docs: DataFrame, low: int, high: int | None = None, least: int = 1, reverse: bool = False) -> DataFrame:
    """(n, ngram, freq) of the lengths low to high with at least so many occurrences.

    With least > 1 an n-gram is counted only if its first word is as frequent (an n-gram
    is never more frequent than its words). reverse: n-grams of the text read backwards.
    """
    high = high or low
    frequent = None
    if least > 1:
        frequent = term_frequency(tokens(docs)).filter(F.col("freq") >= least).select(F.col("word").alias("first"))
    out = None
    for n in range(low, high + 1):
        rows = with_words(docs).select(F.explode(grams(n, F.col("words"))).alias("ngram"))
        if frequent is not None and n > 1:
            rows = rows.withColumn("first", F.substring_index("ngram", " ", 1)).join(frequent, "first", "left_semi")
        made = rows.groupBy("ngram").agg(F.count("*").alias("freq")).filter(F.col("freq") >= least).select(F.lit(n).alias("n"), "ngram", "freq")
        if reverse and n > 1:
            # What is counted is turned round, each n-gram once, not every document.
            made = made.withColumn("ngram", F.array_join(F.reverse(F.split("ngram", " ")), " "))
        out = made if out is None else out.unionByName(made)
    return out


#: Phrases that are sought place by place inside the documents' word arrays; longer lists meet all n-grams in a join.
FEW_PHRASES = 64


def find_phrases(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, doc_id, pos) of each place where a phrase's words stand together; a phrase without words has no place.

    A few phrases: only documents that hold all letters of a phrase's words are cut into words, and
    only hits leave a document. Many phrases: the n-grams of each length are joined with them.
    """
    spark = docs.sparkSession
    wanted = sorted({" ".join(p.split()) for p in phrases} - {""})
    if not wanted:
        return spark.createDataFrame([], "phrase string, doc_id long, pos int")
    if len(wanted) <= FEW_PHRASES:

        def hits_of(phrase: str) -> tuple[Column, Column]:
            words, parts = F.col("words"), phrase.split()
            every = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
            places = F.filter(every, lambda i: reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(parts)]))
            maybe = reduce(Column.__and__, [F.contains(F.col("text"), F.lit(w)) for w in parts])
            found = F.transform(places, lambda i: F.struct(F.lit(phrase).alias("phrase"), i.alias("pos")))
            return maybe, F.when(maybe, found).otherwise(F.array().cast("array<struct<phrase:string,pos:int>>"))

        hits = [hits_of(p) for p in wanted]
        near = docs.filter(reduce(Column.__or__, [m for m, _ in hits])).withColumn("words", tokenize.whitespace(F.col("text")))
        return near.select("doc_id", F.inline(F.concat(*[h for _, h in hits]))).select("phrase", "doc_id", "pos")
    by: dict[int, list[str]] = {}
    for p in wanted:
        by.setdefault(len(p.split()), []).append(p)
    out = None
    for n, some in sorted(by.items()):
        held = spark.createDataFrame([(p,) for p in some], "ngram string")
        made = ngram_positions(docs, n).join(held, "ngram").select(F.col("ngram").alias("phrase"), "doc_id", "pos")
        out = made if out is None else out.unionByName(made)
    return out


def fold(toks: DataFrame, rare: int = 0, numbers: bool = False, classes: DataFrame | None = None) -> DataFrame:
    """Tokens with a column context: explicit class, else <number>, else <rare> under a frequency, else the word.

    classes: (word, class). The vocabulary's frequencies are joined back only for rare > 1.
    """
    out = toks
    if classes is not None:
        out = out.join(classes.select("word", F.col("class").alias("textloom_class")), "word", "left")
    if rare > 1:
        uncommon = term_frequency(toks).filter(F.col("freq") < rare).select("word", F.lit(True).alias("textloom_rare"))
        out = out.join(uncommon, "word", "left")
    context = F.col("word")
    if rare > 1:
        context = F.when(F.col("textloom_rare"), F.lit(RARE)).otherwise(context)
    if numbers:
        context = F.when(T.is_number(F.col("word")), F.lit(NUMBER)).otherwise(context)
    if classes is not None:
        context = F.coalesce("textloom_class", context)
    return out.select("doc_id", "pos", "word", context.alias("context"))


def with_attributes(vocab: DataFrame, words: DataFrame, bit: int) -> DataFrame:
    """The vocabulary with attrs, in which the bit is set for the listed words."""
    marked = words.select("word").distinct().withColumn("textloom_hit", F.lit(1 << bit).cast("bigint"))
    base = vocab if "attrs" in vocab.columns else vocab.withColumn("attrs", F.lit(0).cast("bigint"))
    out = base.join(marked, "word", "left").withColumn("attrs", F.col("attrs").bitwiseOR(F.coalesce("textloom_hit", F.lit(0).cast("bigint"))))
    return out.drop("textloom_hit")


def neighbour_counts(docs: DataFrame, left: int, right: int) -> DataFrame:
    """(word, offset, context, n): how often a context stands at an offset from -left to right but 0; context is null beyond the document.

    A pair of words at a distance is counted once, as the word and what comes after it, and
    turned round when it is counted: what is after the one is before the other. Followers
    come from shifted copies of the document's word array, so no token moves by itself.
    """
    words, most = F.col("words"), max(left, right)
    held = with_words(docs).filter(F.size(words) > 0)
    # arrays_zip fills the shorter copies with nulls.
    copies = [F.slice(words, gap + 1, F.size(words)).alias(f"after{gap}") for gap in range(1, most + 1)]
    rows = held.select(F.inline(F.arrays_zip(words.alias("word"), *copies))).toDF("word", *[f"after{gap}" for gap in range(1, most + 1)])
    cells = F.array(*[F.struct(F.lit(gap).alias("gap"), F.col(f"after{gap}").alias("after")) for gap in range(1, most + 1)])
    pairs = rows.select("word", F.inline(cells)).groupBy("word", "gap", "after").agg(F.count("*").alias("n"))
    ways = [F.when(F.col("gap") <= right, F.struct(F.col("word"), F.col("gap").alias("offset"), F.col("after").alias("context"), F.col("n")))]
    back = F.struct(F.col("after").alias("word"), (-F.col("gap")).alias("offset"), F.col("word").alias("context"), F.col("n"))
    ways.append(F.when((F.col("gap") <= left) & F.col("after").isNotNull(), back))
    out = pairs.select(F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("w")).select("w.*")
    if not left:
        return out
    # The first words of a document have nothing so far before them.
    heads = held.select(F.explode(F.array(*[F.lit(k) for k in range(1, left + 1)])).alias("gap"), "words").select((-F.col("gap")).alias("offset"), F.explode(F.slice(words, F.lit(1), F.col("gap"))).alias("word"))
    lone = heads.groupBy("word", "offset").agg(F.count("*").alias("n")).select("word", "offset", F.lit(None).cast("string").alias("context"), "n")
    return out.unionByName(lone)


def positional_id(word: Column, offset: Column, left: int, right: int) -> Column:
    """One number for a word id and an offset; offsets run from -left to right without 0."""
    return word * (left + right) + offset + left - (offset > 0).cast("bigint")


def positional_offset(pid: Column, left: int, right: int) -> Column:
    place = F.pmod(pid, F.lit(left + right)) - left
    return place + (place >= 0).cast("bigint")


def positional_word(pid: Column, left: int, right: int) -> Column:
    return F.floor(pid / (left + right))


def context_vectors(docs: DataFrame, left: int, right: int, positional: bool = False) -> DataFrame:
    """Sparse one-hot context vectors of the documents' words: (word, context[, offset], weight)."""
    if left == right and left and not positional:
        # A pair stands as often one way round as the other, so it is counted once and turned round after that.
        words = F.col("words")
        copies = [F.slice(words, gap + 1, F.size(words)).alias(f"after{gap}") for gap in range(1, left + 1)]
        rows = with_words(docs).filter(F.size(words) > 1).select(F.inline(F.arrays_zip(words.alias("word"), *copies))).toDF("word", *[f"after{gap}" for gap in range(1, left + 1)])
        near = rows.select("word", F.explode(F.array(*[f"after{gap}" for gap in range(1, left + 1)])).alias("after")).filter("after IS NOT NULL")
        pairs = near.groupBy(F.least("word", "after").alias("a"), F.greatest("word", "after").alias("b")).agg(F.count("*").cast("double").alias("n"))
        ways = [F.struct(F.col("a").alias("word"), F.col("b").alias("context"), F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("weight"))]
        ways.append(F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("word"), F.col("a").alias("context"), F.col("n").alias("weight"))))
        return pairs.select(F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("w")).select("w.*")
    keys = ["word", "context", *(["offset"] if positional else [])]
    return neighbour_counts(docs, left, right).filter("context IS NOT NULL").groupBy(*keys).agg(F.sum("n").cast("double").alias("weight"))


def indexed_vectors(docs: DataFrame, left: int, right: int, dims: int, nonzero: int = 8, seed: int = 0) -> DataFrame:
    """Random-indexing context vectors: (word, dim, weight); a term adds +-1 to a few dimensions of its own."""
    # All of a word's contexts meet in one task, where its numbers are added up: no cell of a vector moves.
    pairs = context_vectors(docs, left, right).repartition("word").sortWithinPartitions("word")

    ends = [f":{k}:{seed}".encode() for k in range(nonzero)]

    def draws(terms: list[str]) -> np.ndarray:
        """Each term's dimensions, counted from 1, with their signs; as T.digest_number draws them."""
        first = b"".join(hashlib.md5(term + end).digest()[:4] for term in (t.encode() for t in terms) for end in ends)
        numbers = np.frombuffer(first, dtype=">u4").astype(np.int64).reshape(-1, nonzero)
        return (numbers % dims + 1) * np.where(numbers >> 31 == 0, 1, -1)

    def rows(words: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        there = sums != 0
        keys = keys[there]
        return pa.RecordBatch.from_arrays([pa.array(words[keys // dims], pa.string()), pa.array(keys % dims, pa.int64()), pa.array(sums[there])], names=["word", "dim", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held, last = np.zeros((KNOWN_TERMS, nonzero), dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            word, context = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            words, terms = word.dictionary.to_numpy(zero_copy_only=False), context.dictionary.to_pylist()
            place = np.array([known.get(t, -1) for t in terms])
            new = [t for t, k in zip(terms, place, strict=True) if k < 0]
            table, fresh = held[place], draws(new)
            table[place < 0] = fresh
            more = min(len(new), KNOWN_TERMS - len(known))
            held[len(known) : len(known) + more] = fresh[:more]
            known.update(zip(new[:more], range(len(known), len(known) + more), strict=True))
            signed = table[context.indices.to_numpy()]
            keys = (word.indices.to_numpy().astype(np.int64)[:, None] * dims + np.abs(signed) - 1).ravel()
            values = (batch.column(2).to_numpy()[:, None] * np.sign(signed)).ravel()
            # A word may go on in the next batch.
            if last is not None and last[0] == words[0]:
                keys, values = np.concatenate([last[1], keys]), np.concatenate([last[2], values])
            elif last is not None:
                yield rows(np.array([last[0]], dtype=object), last[1], last[2])
            keys, at = np.unique(keys, return_inverse=True)
            sums, cut = np.bincount(at, weights=values), np.searchsorted(keys, (len(words) - 1) * dims)
            yield rows(words, keys[:cut], sums[:cut])
            last = words[-1], keys[cut:] % dims, sums[cut:]
        if last is not None:
            yield rows(np.array([last[0]], dtype=object), last[1], last[2])

    return pairs.select("word", "context", "weight").mapInArrow(run, "word string, dim long, weight double")


#: Terms whose draws a task remembers.
KNOWN_TERMS = 100_000


# ---- n-gram language model ----


def counts_of_counts(docs: DataFrame, n: int) -> DataFrame:
    """(freq, ngrams): how many n-grams occur so often."""
    return ngrams(docs, n).groupBy("freq").agg(F.count("*").alias("ngrams"))


@dataclass(frozen=True)
class BigramModel:
    """Written tables of a bigram model: pairs (w1, w2, freq), after (w1, after, total), before (w2, before), and the number of pairs."""

    pairs: DataFrame
    after: DataFrame
    before: DataFrame
    types: int
    discount: float = 0.75


def bigram_model(docs: DataFrame, discount: float = 0.75) -> BigramModel:
    """The corpus is cut into bigrams and counted once; the rest comes from the counts."""
    made = ngrams(docs, 2).select(F.split_part("ngram", F.lit(" "), F.lit(1)).alias("w1"), F.split_part("ngram", F.lit(" "), F.lit(2)).alias("w2"), "freq")
    pairs = materialize(made, "bigrams")
    before = pairs.groupBy("w2").agg(F.count("*").alias("before"))
    after = pairs.groupBy("w1").agg(F.count("*").alias("after"), F.sum("freq").alias("total"))
    return BigramModel(pairs, after, before, pairs.count(), discount)


def _interpolated(model: BigramModel) -> Column:
    """From freq, after, total and before, which are null where the model lacks the pair or a word."""
    d = F.lit(model.discount)
    # A word that follows nothing in the corpus counts as one that follows once among one pair more.
    low = F.coalesce(F.col("before") / F.lit(float(max(1, model.types))), F.lit(1.0 / (model.types + 1)))
    seen = F.greatest(F.coalesce("freq", F.lit(0)) - d, F.lit(0.0)) / F.col("total") + d * F.col("after") / F.col("total") * low
    return F.coalesce(seen, low)


def kneser_ney(docs: DataFrame, discount: float = 0.75) -> DataFrame:
    """(w1, w2, prob): interpolated Kneser-Ney probability of each bigram of the corpus."""
    model = bigram_model(docs, discount)
    return model.pairs.join(model.after, "w1").join(model.before, "w2").select("w1", "w2", _interpolated(model).alias("prob"))


def bigram_probability(pairs: DataFrame, model: BigramModel) -> DataFrame:
    """pairs (w1, w2, ...) with prob; unseen pairs back off to how many words w2 follows, unseen words to the least of all."""
    known = pairs.join(model.pairs, ["w1", "w2"], "left").join(model.after, "w1", "left").join(model.before, "w2", "left")
    return known.select(*pairs.columns, _interpolated(model).alias("prob"))


def longest_match(docs: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(doc_id, pos, length, freq): at each token the longest n-gram of at most so many words that ends there and is in counts (n, ngram, freq).

    length is 0 and freq null where not even the word is known.
    """
    held, out = counts.select("n", "ngram", "freq"), None
    for n in range(1, most + 1):
        ends = ngram_positions(docs, n).select("doc_id", (F.col("pos") + (n - 1)).alias("pos"), F.lit(n).alias("n"), "ngram")
        out = ends if out is None else out.unionByName(ends)
    found = out.join(held, ["n", "ngram"], "left")
    best = F.max(F.struct(F.when(F.col("freq").isNull(), 0).otherwise(F.col("n")).alias("length"), F.col("freq"))).alias("best")
    return found.groupBy("doc_id", "pos").agg(best).select("doc_id", "pos", "best.length", "best.freq")


def backoff_probability(docs: DataFrame, counts: DataFrame, order: int, factor: float = 0.4) -> DataFrame:
    """(doc_id, pos, length, prob) by "stupid" back-off over orders: freq(ngram) / freq(its start) of the longest known n-gram, times factor for each order less.

    counts: (n, ngram, freq) of all orders up to order. A token without its whole context
    starts from the longest one there is; an unknown word has prob 0.
    """
    total = counts.filter("n = 1").agg(F.sum("freq").alias("total"))
    head = F.when(F.col("n") > 1, F.regexp_replace("ngram", r" [^ ]*$", ""))
    starts = counts.select((F.col("n") + 1).alias("n"), F.col("ngram").alias("head"), F.col("freq").alias("base"))
    share = counts.withColumn("head", head).join(starts, ["n", "head"], "left").crossJoin(F.broadcast(total))  # total has one row
    share = share.select("n", "ngram", F.struct((F.col("freq") / F.coalesce("base", "total")).alias("share"), "freq").alias("freq"))
    found = longest_match(docs, share, order)
    missing = F.least(F.col("pos") + 1, F.lit(order)) - F.col("length")
    return found.select("doc_id", "pos", "length", F.when(F.col("length") > 0, F.col("freq.share") * F.pow(F.lit(factor), missing)).otherwise(0.0).alias("prob"))


def running_text(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, line): each document's words and <eol> marks as one text, of at most so many tokens."""
    words = F.flatten(F.transform(F.split("text", "\n"), lambda s: F.concat(tokenize.whitespace(s), F.array(F.lit(EOL)))))
    return docs.select("doc_id", F.array_join(words if most is None else F.slice(words, 1, most), " ").alias("line"))


def suffixes(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, pos, suffix): the first depth words from each position, in the order of the words."""
    rows = with_words(docs).select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    cut = F.slice("words", F.col("pos") + 1, F.lit(depth))
    return rows.select("doc_id", "pos", cut.alias("key")).orderBy("key", "doc_id", "pos").select("doc_id", "pos", F.array_join("key", " ").alias("suffix"))


def add_terms(pairs: DataFrame, term_vectors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Context vectors (key, dim, val) += weight * vector of each context term; terms without a vector add nothing.

    pairs: (key, term, weight); term_vectors: (term, dim, val); weights: (term, factor), 1 where a term is not listed.
    """
    rows = pairs
    if weights is not None:
        rows = rows.join(weights, "term", "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    # Repeated terms of a key are summed before the vectors' cells are joined on.
    rows = rows.groupBy("key", "term").agg(F.sum("weight").alias("weight"))
    return rows.join(term_vectors, "term").groupBy("key", "dim").agg(F.sum(F.col("weight") * F.col("val")).alias("val"))


def perplexity(docs: DataFrame, model: BigramModel) -> DataFrame:
    """(doc_id, bigrams, perplexity) of documents under a bigram model, unseen bigrams included; documents of fewer than two words are left out."""
    pair = [F.split_part("ngram", F.lit(" "), F.lit(k)).alias(f"w{k}") for k in (1, 2)]
    # The model scores each bigram once, however many documents have it; the documents' own rows move once.
    distinct = with_words(docs).select(F.explode(grams(2, F.col("words"))).alias("ngram")).distinct()
    scored = bigram_probability(distinct.select("ngram", *pair), model).select("ngram", F.log("prob").alias("log"))
    scored = materialize(scored, "scored")
    release(docs.sparkSession)
    met = ngram_positions(docs, 2).select("doc_id", "ngram").join(scored, "ngram")
    return met.groupBy("doc_id").agg(F.count("*").alias("bigrams"), F.exp(-F.avg("log")).alias("perplexity"))


def filtered_ngrams(docs: DataFrame, low: int, high: int, keep: Callable[[Column], Column], words: Callable[[Column], Column] = tokenize.whitespace) -> DataFrame:
    """(n, ngram, freq) of the n-grams that pass a test of the caller's on their array of words, under a tokenizer of the caller's."""
    held = docs.select(words(F.col("text")).alias("words"))

    def of_length(n: int) -> DataFrame:
        size = F.size("words")
        runs = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice("words", i, n)))
        rows = held.select(F.explode(F.filter(runs, keep)).alias("gram"))
        return rows.groupBy(F.array_join("gram", " ").alias("ngram")).agg(F.count("*").alias("freq")).select(F.lit(n).alias("n"), "ngram", "freq")

    return reduce(DataFrame.unionByName, map(of_length, range(low, high + 1)))
