"""Counts and models that move the documents' rows as few times as they can: results by brute force, and the plans' exchanges."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, language_model

TEXTS = [(1, "a b a b c"), (2, "b b  b a"), (2, "c"), (3, None), (4, ""), (5, "a a d\te a b c"), (6, "a b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def exchanges(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join") + df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")


def test_reversed_ngrams(spark, docs):
    """ngram_reverse: n-grams are turned round once each, not every document's words."""
    found = corpus.ngrams(docs, 3, reverse=True)
    assert "reverse(words" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = [(t or "").split()[::-1] for _, t in TEXTS]
    assert {r["ngram"]: r["freq"] for r in found.collect()} == Counter(" ".join(w[i : i + 3]) for w in words for i in range(len(w) - 2))
    assert {r["ngram"] for r in corpus.ngrams(docs, 1, 2, least=3, reverse=True).collect()} == {"a", "b", "c", "b a"}


def test_context_vectors_count_pairs_once(spark, docs):
    """ctx_vector: pairs are counted whichever word comes first, in one aggregate."""
    found = corpus.context_vectors(docs, 2, 2)
    assert exchanges(found) == 1
    want = Counter()
    for _, t in TEXTS:
        w = (t or "").split()
        want.update((w[i], w[j]) for i in range(len(w)) for j in range(len(w)) if 0 < abs(i - j) <= 2)
    got = found.collect()
    assert len(got) == len(want) and {(r["word"], r["context"]): r["weight"] for r in got} == want
    uneven = {(r["word"], r["context"]): r["weight"] for r in corpus.context_vectors(docs, 1, 2).collect()}
    assert uneven["d", "e"] == 1 and ("d", "b") not in uneven


def test_perplexity_moves_rows_once(spark, docs):
    """lm_perplexity: the documents' bigrams meet one table of scores; unseen pairs and words count."""
    model = corpus.bigram_model(docs)
    other = spark.createDataFrame([(1, "a b c a"), (2, "z a"), (3, "a z y"), (3, "b a"), (4, "a")], "doc_id long, text string")
    found = corpus.perplexity(other, model)
    assert exchanges(found) == 2
    pairs = spark.createDataFrame([(d, *p) for d, t in other.collect() for w in [t.split()] for p in zip(w, w[1:])], "doc_id long, w1 string, w2 string")
    logs: dict[int, list[float]] = {}
    for r in corpus.bigram_probability(pairs, model).collect():
        logs.setdefault(r["doc_id"], []).append(math.log(r["prob"]))
    got = {r["doc_id"]: (r["bigrams"], r["perplexity"]) for r in found.collect()}
    assert got.keys() == logs.keys()
    assert all(got[d][0] == len(x) and abs(got[d][1] - math.exp(-sum(x) / len(x))) < 1e-9 for d, x in logs.items())


def test_trigrams_meet_two_tables(spark, docs):
    """lm_trigrams: the model's own trigrams are joined twice, and score as any other table of the same trigrams."""
    model = language_model.train(docs, 3)
    own = model.orders[-1].grams
    found = language_model.probability(own, model)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    again = language_model.probability(own.withColumn("more", F.lit(1)), model)
    rows = lambda df: {(r["w1"], r["w2"], r["w3"]): round(r["prob"], 12) for r in df.collect()}
    assert rows(found) == rows(again) and found.columns == [*own.columns, "prob"]
    mixed = spark.createDataFrame([("a", "b", "c"), ("a", "b", "c"), ("a", "b", "z"), ("z", "b", "a"), ("z", "z", "z")], "w1 string, w2 string, w3 string")
    got = language_model.probability(mixed, model).collect()
    assert len(got) == 5 and {r["prob"] > 0 for r in got} == {True}
    vocabulary = ["a", "b", "c", "d", "e"]
    for context in (("a", "b"), ("z", "a"), ("z", "z")):
        every = spark.createDataFrame([(*context, w) for w in vocabulary], "w1 string, w2 string, w3 string")
        assert abs(sum(r["prob"] for r in language_model.probability(every, model).collect()) - 1) < 1e-9


def test_random_indexing_adds_up_in_one_task(spark, docs):
    """ctx_random_index: no cell of a vector is exchanged; words that go on over several batches."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for left, right, dims, nonzero, seed in ((2, 2, 5, 3, 0), (1, 2, 64, 8, 7)):
            found = corpus.indexed_vectors(docs, left, right, dims, nonzero, seed)
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
            want = Counter()
            for r in corpus.context_vectors(docs, left, right).collect():
                for k in range(nonzero):
                    x = int(hashlib.md5(f"{r['context']}:{k}:{seed}".encode()).hexdigest()[:8], 16)
                    want[r["word"], x % dims] += r["weight"] * (1 if x < 1 << 31 else -1)
            got = found.collect()
            assert len(got) == len({(r["word"], r["dim"]) for r in got})
            assert {(r["word"], r["dim"]): r["weight"] for r in got} == {k: x for k, x in want.items() if x}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
