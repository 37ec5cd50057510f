"""Piece ids and texts against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())


@pytest.fixture(scope="module")
def held():
    return pieces.vocabulary(pieces.vocabulary_path())


def same(held, library, texts):
    ids, counts = pieces.encode(held, texts)
    want = [library.encode(t or "") for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == want
    assert [x.decode() for x in pieces.decode(held, ids, counts)] == [library.decode(x) for x in want]
    assert [x.decode() for x in pieces.joined_ids(held, ids, counts)] == [",".join(map(str, x)) for x in want]


EDGES = ["", None, " ", "   a  b", " " * 100, "▁x ▁ y", "a" * 5000, "\n\n x\t", "é " * 300 + "ß", "中文字符 漢字", "😀😀 a😀b", "\0", "x�y",
         "abcabcabc" * 50, "word " * 2000, "x" + " " * 47 + "y" + " " * 48, "　 ​", "<s></s><unk><0x0A>", "3.14 1e9", "퟿", "thethethe" * 100, "_" * 160 + "=" * 33]


def test_edges(held, library):
    assert held.runs is not None
    same(held, library, EDGES)
    same(held, library, [])
    same(held, library, [None, ""])


def test_random_texts(held, library):
    rng = random.Random(1)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    same(held, library, ["".join(rng.choices(names, k=rng.randint(1, 60))) for _ in range(1500)])
    same(held, library, ["".join(rng.choices(" \n\taethno", k=rng.randint(1, 200))) for _ in range(1500)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=60), max_size=8))
def test_any_text(held, library, texts):
    same(held, library, texts)


def test_runs_without_table(held, library):
    """Runs of marks through the rounds themselves: ties in score, and merges that wait for the ones before."""
    from dataclasses import replace

    names = {library.id_to_piece(i): i for i in range(259, 32_000)}
    pairs = {(names["▁" * a] << 22) | names["▁" * b]: names["▁" * (a + b)] for a in range(1, 16) for b in range(1, 16) if "▁" * a in names and "▁" * b in names and "▁" * (a + b) in names}
    plain = held.pairs.keys >= 0
    keys, values = [*held.pairs.keys[plain].tolist(), *pairs], [*held.pairs.values[plain].tolist(), *pairs.values()]
    rounds = replace(held, runs=None, pairs=pieces.Pairs(np.array(keys), np.array(values, dtype=np.int32)))
    same(rounds, library, [*(" " * n for n in range(60)), "a" + " " * 30 + "b  c", *EDGES])


def test_decode_any_ids(held, library):
    rng = random.Random(2)
    lists = [[rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 30))] for _ in range(600)]
    lists += [[1, 28705, 264], [28705, 264], [0, 264], [3, 264], [240, 159], [229]]
    got = pieces.decode(held, np.array([i for x in lists for i in x]), np.array([len(x) for x in lists]))
    assert [x.decode() for x in got] == [library.decode(x) for x in lists]


def test_tables(spark, sf, odd, odd_rows, none, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for table, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), None), (odd, odd_rows)):
        texts = [(r[0], r[1]) for r in rows] if rows else [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        want = []
        for i, t in texts:
            ids = library.encode(t or "")
            want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
        got = [tuple(r) for r in (pieces.op11_sentencepiece(spark, sf) if rows is None else pieces.digests(table)).collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted(want, key=key)
    from pyspark.sql import functions as F

    made = pieces.encode_documents(odd.withColumn("piece_ids", F.lit("clash")))
    assert made.columns[-2:] == ["piece_ids_", "piece_text"]
    for r in made.collect():
        assert r["piece_ids_"] == library.encode(r["text"] or "") and r["piece_text"] == (r["text"] or "") and r["piece_ids"] == "clash"
    back = pieces.decode_table(made.select("doc_id", "piece_ids_", "piece_text"), "piece_ids_")
    assert back.columns[-1] == "piece_text_" and back.filter("piece_text <> piece_text_").count() == 0
    assert pieces.digests(none).count() == 0 and pieces.encode_documents(none).count() == 0


def test_pairs():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, size=5000))
    table = pieces.Pairs(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.find(keys >> 22, keys & ((1 << 22) - 1)) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, size=5000), keys)
    assert (table.find(other >> 22, other & ((1 << 22) - 1)) == -1).all()


def test_words_of_equal_code(monkeypatch):
    """Words are told apart by their characters, whatever their codes."""
    points = np.array([97, 98, 97, 98, 99, 97, 98], dtype=np.int32)
    some, number = pieces._distinct(points, np.array([0, 2, 5]), np.array([2, 3, 2]))
    assert number[0] == number[2] != number[1] and len(some) == 2
