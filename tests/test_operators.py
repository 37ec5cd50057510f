from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import measures as M
from textloom.operators import cluster, corpus, graph, relations, tables, trie
from textloom.sources import io
from textloom.streaming import counts

DOCS = [(1, "a b a\nc 12"), (2, ""), (3, "b a b a b"), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_vocabulary_ids(spark, docs):
    rows = corpus.vocabulary_ids(corpus.tokens(docs)).orderBy("id").collect()
    assert [(r["id"], r["word"], r["freq"]) for r in rows] == [(0, "a", 4), (1, "b", 4), (2, "c", 1), (3, "12", 1)]


def test_ngrams(spark, docs):
    got = {(r["n"], r["ngram"]): r["freq"] for r in corpus.ngrams(docs, 1, 3).collect()}
    wanted = Counter()
    for _, t in DOCS:
        w = (t or "").split()
        for n in (1, 2, 3):
            wanted.update((n, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    assert got == dict(wanted)
    frequent = {r["ngram"]: r["freq"] for r in corpus.ngrams(docs, 2, least=2).collect()}
    assert frequent == {k[1]: v for k, v in wanted.items() if k[0] == 2 and v >= 2}


def test_fold_and_contexts(spark, docs):
    classes = spark.createDataFrame([("a", "A")], "word string, class string")
    got = {(r["doc_id"], r["pos"]): r["context"] for r in corpus.fold(corpus.tokens(docs), 3, True, classes).collect()}
    assert [got[1, i] for i in range(5)] == ["A", "b", "A", "<rare>", "<number>"]
    around = {(r["word"], r["offset"], r["context"]): r["n"] for r in corpus.neighbour_counts(docs, 2, 1).groupBy("word", "offset", "context").agg(F.sum("n").alias("n")).collect()}
    wanted = Counter()
    for _, t in DOCS:
        w = (t or "").split()
        for i, x in enumerate(w):
            for o in (-2, -1, 1):
                wanted[x, o, w[i + o] if 0 <= i + o < len(w) else None] += 1
    assert around == dict(wanted)
    probs = corpus.kneser_ney(docs).groupBy("w1").agg(F.sum("prob").alias("p")).collect()
    assert all(0 < r["p"] <= 1 + 1e-9 for r in probs)


def test_phrases(spark, docs):
    assert corpus.find_phrases(docs, ["", " "]).count() == 0
    many = [f"none {i}" for i in range(80)]
    found = [sorted(map(tuple, corpus.find_phrases(docs, ["a b", "12", "b a b", *more]).collect())) for more in ([], many)]
    assert found[0] == found[1] and ("b a b", 3, 2) in found[0]
    rows = corpus.find_phrases(docs, ["a b", "12", "zzz z"]).collect()
    assert sorted((r["phrase"], r["doc_id"], r["pos"]) for r in rows) == [("12", 1, 4), ("a b", 1, 0), ("a b", 3, 1), ("a b", 3, 3)]


def test_dense_ids_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = tables.dense_ids(df, ["k"]).collect()
    assert all(r["k"] == r["id"] for r in rows)


def test_discard(spark):
    held = tables.materialize(spark.range(5), "short")
    path = held.inputFiles()[0]
    assert held.count() == 5 and spark.read.parquet(path).count() > 0
    tables.discard(held)
    tables.discard(held)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_relations(spark):
    rows = spark.createDataFrame([(k, i, i * i) for i, k in enumerate("abcab")], "k string, i int, v int")
    assert sorted(map(tuple, relations.first_wins(rows, "k", ["i"]).collect())) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 4)]
    assert relations.sample(rows, "i", 2).count() == 2
    top = relations.top_by_group(rows, ["k"], 1, [F.desc("i")]).collect()
    assert sorted((r["k"], r["i"]) for r in top) == [("a", 3), ("b", 4), ("c", 2)]


def test_trie(spark):
    keys = spark.createDataFrame([("ab",), ("abc",), ("b",), ("",), ("b",)], "key string")
    assert {r["prefix"]: r["keys"] for r in trie.nodes(keys).collect()} == {"a": 2, "ab": 2, "abc": 1, "b": 1}
    assert sorted(r["key"] for r in trie.terminal(keys).collect()) == ["", "abc", "b"]


def test_spanning_forest(spark):
    rng = random.Random(3)
    edges = [(a, b, float(rng.randrange(20))) for a in range(30) for b in range(a) if rng.random() < 0.15]
    parent = list(range(30))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    wanted = set()
    for n, a, b in sorted((n, min(a, b), max(a, b)) for a, b, n in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            wanted.add((a, b, n))
    got = graph.spanning_forest(spark.createDataFrame(edges, "src long, dst long, len double")).collect()
    assert {tuple(r) for r in got} == wanted


def test_clusters(spark):
    rows = [(i, [1.0 + 0.01 * i, 0.0]) for i in range(5)] + [(i, [0.0, 1.0 + 0.01 * i]) for i in range(5, 10)] + [(10, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for text in ("method=kmeans:k=2", "method=kmedoids:k=2", "method=incr:k=2:threshold=0.5", "method=brown:k=3:threshold=-1"):
        got = {r["vec_id"]: r["cluster"] for r in cluster.run(df, text).collect()}
        assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[5], text
    got = {r["vec_id"]: r["cluster"] for r in cluster.run(df.filter("vec_id < 10"), "method=dbscan:epsilon=0.1:min_points=3").collect()}
    assert got == {i: 0 if i < 5 else 5 for i in range(10)}
    seeds = df.withColumn("label", F.when(F.col("vec_id") == 0, 1).when(F.col("vec_id") == 5, 2))
    grown = {r["vec_id"]: r["label"] for r in cluster.grow_seeds(seeds).collect()}
    assert grown == {**{i: 1 for i in range(5)}, **{i: 2 for i in range(5, 10)}, 10: None}
    with pytest.raises(ValueError):
        cluster.parse_options("nothing=1")


def test_merging_in_rounds(spark):
    """Mutual nearest clusters at once give what one merge after the other gives."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(40, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    unit = np.array([v for _, v in rows])
    unit[:40] /= np.linalg.norm(unit[:40], axis=1, keepdims=True)
    groups = [[i] for i in range(41)]
    for k, least in ((6, -2.0), (1, 0.2)):
        while len(groups) > k:
            sims = {(a, b): float(unit[x].sum(axis=0) @ unit[y].sum(axis=0) / len(x) / len(y)) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b}
            a, b = max(sims, key=sims.get)
            if sims[a, b] < least:
                break
            groups[a] += groups.pop(b)
        got = {}
        for r in cluster.agglomerate(df, cluster.Options(k=k, threshold=least)).collect():
            got.setdefault(r["cluster"], []).append(r["vec_id"])
            assert r["path"].startswith("B") and set(r["path"][1:]) <= {"0", "1"}
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
        groups = [[i] for i in range(41)]


@pytest.mark.parametrize("measure, epsilon", [("cosine", 0.1), ("cosine", 1.0), ("euclidean", 0.4), ("squared_euclidean", 0.2), ("manhattan", 0.5), ("canberra", 0.8)])
def test_within(spark, measure, epsilon):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(120)] + [(200, [0.0, 0.0, 0.0]), (201, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    every = df.join(df.select(F.col("vec_id").alias("other"), F.col("v").alias("w")), F.col("vec_id") != F.col("other"))
    far = M.distance(measure, "v", "w")
    wanted = {(r["vec_id"], r["other"]): r["dist"] for r in every.filter(far <= epsilon).select("vec_id", "other", far.alias("dist")).collect()}
    found = cluster.within(df, epsilon, measure).collect()
    got = {(r["vec_id"], r["other"]): r["dist"] for r in found}
    assert got.keys() == wanted.keys() and len(found) == len(wanted) and wanted
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


def test_searches_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i % 5, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, cluster long, v array<double>").repartition(3)
    centres = df.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("centre"), F.col("v").alias("cv"))

    def results():
        return [
            sorted((r["vec_id"], r["centre"], round(r["sim"], 9)) for r in cluster.nearest(df, centres).collect()),
            sorted((r["vec_id"], r["centre"], round(r["sim"], 9)) for r in cluster.nearest(df, centres, "euclidean").collect()),
            sorted((r["query"], r["rank"], r["vec_id"]) for r in cluster.neighbours(df, df, 4).collect()),
            sorted((r["c1"], r["c2"], round(r["sim"], 9)) for how in ("nearest", "furthest") for r in cluster.linkage(df, how).collect()),
            sorted((r["c1"], r["c2"], round(r["dist"], 9)) for how in ("nearest", "furthest", "average") for r in cluster.linkage(df, how, "euclidean", "distance").collect()),
            sorted((r["cluster"], r["vec_id"], round(r["value"], 9)) for how in ("nearest", "furthest", "average") for r in cluster.to_vectors(df, df, how).collect()),
        ]

    whole = results()
    monkeypatch.setattr(cluster, "MAX_CENTRE_CELLS", 50)
    assert results() == whole


def test_backoff(spark, docs):
    model = corpus.bigram_model(docs)
    unseen = spark.createDataFrame([("b", "c"), ("zz", "a"), ("a", "zz"), ("a", "b")], "w1 string, w2 string")
    got = {(r["w1"], r["w2"]): r["prob"] for r in corpus.bigram_probability(unseen, model).collect()}
    known = {(r["w1"], r["w2"]): r["prob"] for r in corpus.kneser_ney(docs).collect()}
    assert got["a", "b"] == pytest.approx(known["a", "b"]) and all(0 < p < 1 for p in got.values())
    counts = corpus.ngrams(docs, 1, 3)
    text = spark.createDataFrame([(1, "a b a zz b")], "doc_id long, text string")
    assert [r["length"] for r in corpus.longest_match(text, counts, 3).orderBy("pos").collect()] == [1, 2, 3, 0, 1]


def test_representatives_grow(spark):
    assert cluster.all_sparse_or_dense(spark.createDataFrame([([1.0], None), ([2.0], None)], "dense array<double>, sparse map<int,double>"))
    assert not cluster.all_sparse_or_dense(spark.createDataFrame([([1.0], None), (None, {1: 2.0})], "dense array<double>, sparse map<int,double>"))


def test_fold_callback(spark):
    rows = spark.createDataFrame([("x", i, i) for i in range(5)], "k string, i int, v int")
    got = relations.fold(rows, ["k"], ["i"], F.lit(""), lambda state, r: F.concat(state, r["v"].cast("string")))
    assert [tuple(r) for r in got.collect()] == [("x", "01234")]


def test_xz_lines(spark, tmp_path):
    import lzma

    text = "".join(f"line {i} é\n" for i in range(5000)) + "the last"
    (tmp_path / "a.txt.xz").write_bytes(lzma.compress(text.encode()))
    got = [r["value"] for r in io.read_xz_lines(spark, str(tmp_path / "a.txt.xz")).collect()]
    assert got == text.split("\n")


def test_io(spark, docs, tmp_path):
    lines = spark.createDataFrame([(" a ",), ("",), ("#c",), ("d;e",)], "value string").coalesce(1)
    path = str(tmp_path / "lines")
    io.write_lines(lines, path, "gzip")
    assert sorted(r["value"] for r in io.without_blank(io.trimmed(io.read_lines(spark, path))).collect()) == ["#c", "a", "d;e"]
    assert sorted(r["word"] for r in io.read_word_list(spark, path).collect()) == ["a", "d"]
    (tmp_path / "pairs.txt").write_text("a\nb\nc\nd\n")
    numbered = io.numbered_lines(spark, str(tmp_path / "pairs.txt"))
    assert [r["value"] for r in io.mono_lines(numbered, -1).orderBy("line_no").collect()] == ["b", "d"]
    assert [r["lines"] for r in io.line_batches(numbered, 3).orderBy("batch").collect()] == [["a", "b", "c"], ["d"]]
    assert io.skip_lines(numbered, 3).count() == 1
    io.save_corpus(docs, str(tmp_path / "corpus"))
    toks, vocab = io.load_corpus(spark, str(tmp_path / "corpus"))
    assert sorted(map(tuple, toks.collect())) == sorted(map(tuple, corpus.tokens(docs).select("doc_id", "pos", "word").collect()))
    ints = spark.createDataFrame([(bytearray([1, 0, 255, 255, 9]),)], "b binary").select(io.fixed_ints(F.col("b"), 16), io.fixed_ints(F.col("b"), 16, False, True)).first()
    assert [list(map(int, x)) for x in ints] == [[1, 65535], [256, -1]]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a b"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 01:00:00", "z")], "t string, text string")
    rows.select(F.to_timestamp("t").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = counts.word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["word"], r["n"]) for r in spark.table("words").collect()) == [("a", 2), ("b", 1), ("z", 1)]


def test_signed_and_replaced_tables(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "signed")
    io.save_signed(df, path, "vocab", 2)
    assert io.load_signed(spark, path, "vocab", 2).count() == 3
    for name, least in (("other", 0), ("vocab", 3)):
        with pytest.raises(io.WrongSignature):
            io.load_signed(spark, path, name, least)
    target = str(tmp_path / "table")
    io.replace_table(df, target)
    io.replace_table(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and spark.read.parquet(target + ".bak").count() == 3
    (tmp_path / "a.ini").write_text("[x]\nk = 1\n")
    assert io.read_config(spark, str(tmp_path / "a.ini")) == {"x": {"k": "1"}}


def test_same_clusters(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "vec_id long, cluster string")
    a = make([(1, "p"), (2, "p"), (3, "q")])
    assert cluster.same_clusters(a, make([(1, "z"), (2, "z"), (3, "y")]))
    assert not cluster.same_clusters(a, make([(1, "z"), (2, "y"), (3, "y")]))
    paths = spark.createDataFrame([(1, "B00"), (2, "B01"), (3, "B1")], "vec_id long, path string")
    assert cluster.same_clusters(cluster.flatten(paths), make([(1, "m"), (2, "m"), (3, "n")]))


def test_add_terms(spark):
    pairs = spark.createDataFrame([("k", "t", 2.0), ("k", "t", 1.0), ("k", "none", 5.0)], "key string, term string, weight double")
    vecs = spark.createDataFrame([("t", 0, 1.0), ("t", 3, -1.0)], "term string, dim int, val double")
    weights = spark.createDataFrame([("t", 0.5)], "term string, factor double")
    assert sorted(map(tuple, corpus.add_terms(pairs, vecs, weights).collect())) == [("k", 0, 1.5), ("k", 3, -1.5)]
