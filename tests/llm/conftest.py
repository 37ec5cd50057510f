from __future__ import annotations

import os
import random

import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in all columns, empty and very long texts, repeated rows, text without letters."""
    return [
        (1, "The MIT License. Released\nunder the mit license", "en", "s"),
        (2, "", "en", None),
        (3, None, None, None),
        (None, "no id here", "en", "s"),
        (4, LONG, "en", "s"),
        (5, "same same", "fr", "s"),
        (5, "same same", "fr", "s"),
        (6, "same same", None, "s"),
        (7, "123 ... !!!\n\n 9", "en", "s"),
        (8, "é " * 300 + "ß", "de", "s"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """documents with columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("key", "fp", "shard", "size", "score", "body", "n_lines", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus_rows():
    """Invented documents with copies, near copies and shared lines."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["  Shared Line ", "shared line", "SHARED LINE\t"]))
        rows.append((i, "\n".join(lines)))
    for i in range(120, 150):
        rows.append((i, rows[rng.randrange(8)][1]))
    for i in range(150, 180):
        text = rows[rng.randrange(20)][1].split(" ")
        text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    return rows


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, "doc_id long, text string").repartition(3)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF
