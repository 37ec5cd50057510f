"""Repeated runs of words by counted digests: against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from textloom.operators import repeats


@pytest.fixture(scope="module")
def texts():
    """Few words with many repeats, a long text in three documents and twice in one, copies, nulls, empty texts, a shared doc_id."""
    rng = random.Random(4)
    rows = [(i // 2, " ".join(rng.choices("ab c dd a\x01 é".split(" "), k=rng.randint(0, 40)))) for i in range(25)]
    body = " ".join(rng.choices("x y z".split(), k=70))
    rows += [(100, body), (101, "q " + body), (102, body + " end " + body), (103, None), (104, ""), (105, "a"), (106, " \n\t")]
    return rows + [(200 + i, " same text\x0bof all copies\nhere and there again ") for i in range(5)]


def grams(rows, n):
    return [(k, i, tuple(w[i : i + n])) for k, (_, t) in enumerate(rows) for w in [(t or "").split()] for i in range(len(w) - n + 1)]


def test_repeat_counts(spark, texts, monkeypatch):
    """repeat_lengths: no suffix is sorted; several sorted pieces in a part."""
    monkeypatch.setattr(repeats, "WORDS", 50)
    monkeypatch.setattr(repeats, "ROWS", 3)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    lengths = [1, 2, 3, 4, 8, 64, 500]
    want = {}
    for n in lengths:
        count = Counter(g for _, _, g in grams(texts, n))
        if count:
            want[n] = sum(c for c in count.values() if c > 1)
    assert dict(map(tuple, repeats.repeat_counts(docs, lengths).collect())) == want
    assert repeats.repeat_counts(docs.limit(0), lengths).count() == 0


def test_counted_digests():
    """Digests that agree in 64 bits and differ in the others are two; packing gives back what it got."""
    d, e = np.array([5, 5, 5, 2**63, 5], dtype=np.uint64), np.array([1, 2, 1, 0, 2], dtype=np.uint16)
    got = repeats.counted(d, e)
    assert [x.tolist() for x in got] == [[5, 5, 2**63], [1, 2, 0], [2, 2, 1]]
    assert [x.tolist() for x in repeats.unpacked(repeats.packed(*got))] == [x.tolist() for x in got]


@pytest.mark.parametrize("least", [1, 3, 20, 50])
def test_repeated_spans(spark, texts, least):
    """repeated_passages: spans by the least digests, documents with one doc_id apart."""
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    count = Counter(g for _, _, g in grams(texts, least))
    places = {(k, i) for k, i, g in grams(texts, least) if count[g] > 1}
    want = []
    for k, i in sorted(places):
        if (k, i - 1) not in places:
            j = i
            while (k, j + 1) in places:
                j += 1
            want.append((texts[k][0], i, j + least))
    got = [(r["doc_id"], r["start"], r["stop"]) for r in repeats.repeated_spans(docs, least).collect()]
    assert sorted(got) == sorted(want)
