"""Suffix arrays, line numbers, pruned centres, models of any order, spelling, replacement: against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.operators import cluster, graph, language_model, spelling, suffix
from textloom.operators.prune import Centres, unit
from textloom.sources import io


def brute_suffixes(rows):
    """(place, doc_id, pos, rest, lcp) by sorting all suffixes."""
    held = sorted(((w[i:], d, i) for d, t in rows for w in [(t or "").split()] for i in range(len(w))), key=lambda s: (s[0], s[1], s[2]))
    out = []
    for k, (w, d, i) in enumerate(held):
        before = held[k - 1][0] if k else []
        same = next((n for n, (a, b) in enumerate(zip(before, w)) if a != b), min(len(before), len(w)))
        out.append((k, d, i, len(w), same))
    return out


@pytest.fixture(scope="module")
def texts():
    """Random words with many repeats, a long text in three documents, copies, nulls and empty texts."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab c dd a\x01".split(" "), k=rng.randint(0, 40)))) for i in range(25)]
    body = " ".join(rng.choices("x y z".split(), k=150))
    rows += [(100, body), (101, "q " + body), (102, body + " end"), (103, None), (104, ""), (105, "a"), (106, " \n\t")]
    return rows + [(200 + i, "same text of all copies\nhere and there again") for i in range(5)]


@pytest.mark.parametrize("head", [8, 2])
def test_suffix_table(spark, texts, head):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    table = suffix.suffix_table(docs, head)
    got = sorted((r["place"], r["doc_id"], r["pos"], r["rest"], r["lcp"]) for r in table.collect())
    assert got == brute_suffixes(texts)
    if head == 8:
        for least in (3, 20):
            hits = {}
            for d, t in texts:
                w = (t or "").split()
                for i in range(len(w) - least + 1):
                    hits.setdefault(tuple(w[i : i + least]), []).append((d, i))
            places = {p for found in hits.values() if len(found) > 1 for p in found}
            want = set()
            for d, i in places:
                if (d, i - 1) not in places:
                    j = i
                    while (d, j + 1) in places:
                        j += 1
                    want.add((d, i, j + least))
            assert {(r["doc_id"], r["start"], r["stop"]) for r in suffix.repeated_spans(table, least).collect()} == want
    assert suffix.suffix_table(docs.limit(0), head).count() == 0


def test_stored_suffixes(spark, texts, tmp_path):
    """Phrases of any length are found, and a lookup's filters reach the scan."""
    path = str(tmp_path / "suffixes")
    suffix.save(suffix.suffix_table(spark.createDataFrame(texts, "doc_id long, text string")), path, 4)
    assert suffix.load(spark, path).count() == len(brute_suffixes(texts))
    body = texts[25][1].split()
    for phrase in ("a", "ab c", "x", "of all", " ".join(body[3:11]), " ".join(body[10:41]), "zz", "", "same text of all copies here and there again"):
        words = phrase.split()
        want = sorted((d, i) for d, t in texts for w in [(t or "").split()] for i in range(len(w)) if words and w[i : i + len(words)] == words)
        assert sorted(map(tuple, suffix.find(spark, path, phrase).collect())) == want
    plan = suffix.find(spark, path, "ab c")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(head,ab" in plan and "LessThan(head,ab" in plan


def test_numbered_lines(spark, tmp_path):
    """Files of many splits, one without lines, one without an end of line, one compressed: numbers as one reader counts them."""
    import gzip

    rng, want = random.Random(1), set()
    folder = tmp_path / "files"
    folder.mkdir()
    for k in range(4):
        lines = ["" if rng.random() < 0.1 else f"{k}:{i}:" + "x" * rng.randint(0, 300) for i in range((0, 1, 6000, 9000)[k])]
        lines[-1:] = ["the end"] if lines else []
        want |= {(f"f{k}.txt", i, x) for i, x in enumerate(lines)}
        (folder / f"f{k}.txt").write_text("\n".join(lines) + ("\n" if k % 2 and lines else ""))
    with gzip.open(folder / "g.txt.gz", "wt") as f:
        f.write("".join(f"line {i}\n" for i in range(3000)))
    want |= {("g.txt.gz", i, f"line {i}") for i in range(3000)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = io.numbered_lines(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 15
        assert {(r["file"].rsplit("/", 1)[-1], r["line_no"], r["value"]) for r in got.collect()} == want
        batches = io.line_batches(io.skip_lines(got, 5), 1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(len(r["lines"]) for r in batches) == len([w for w in want if w[1] >= 5])


def test_pruned_centres():
    """The same centres as all comparisons give; on clustered vectors most are never made."""
    rng = np.random.default_rng(7)
    heads = unit(rng.normal(size=(40, 24)))
    m = unit(np.repeat(heads, 25, axis=0) + 0.02 * rng.normal(size=(1000, 24)))
    x = unit(heads[rng.integers(40, size=3000)] + 0.02 * rng.normal(size=(3000, 24)))
    for centres, rows, most in ((m, x, 0.2), (unit(rng.normal(size=(300, 8))), unit(rng.normal(size=(500, 8))), 1.2), (np.vstack([m[:50], m[:50], np.zeros((2, 24))]), np.vstack([x[:200], np.zeros((3, 24))]), 1.4)):
        held = Centres(np.arange(len(centres)), centres)
        at, sims = held.nearest(rows)
        every = np.round(rows @ centres.T, 12)
        assert (at == every.argmax(axis=1)).all() and np.allclose(sims, every.max(axis=1))
        assert held.compared < most * len(rows) * len(centres)


def test_blocks_one_after_the_other(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    centres = rows.filter("vec_id < 40").selectExpr("vec_id as centre", "v as cv")
    want = {r["vec_id"]: r["centre"] for r in cluster.nearest(rows, centres).collect()}
    lists = {m: sorted(map(tuple, cluster.neighbours(rows.filter("vec_id < 30"), rows, 3, m).collect())) for m in ("cosine", "euclidean")}
    monkeypatch.setattr(cluster, "MAX_CENTRE_CELLS", 40)
    assert {r["vec_id"]: r["centre"] for r in cluster.nearest(rows, centres).collect()} == want
    for m, found in lists.items():
        assert sorted(map(tuple, cluster.neighbours(rows.filter("vec_id < 30"), rows, 3, m).collect())) == found and len(found) == 90


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1040)] + [(2000, 2000)] + [(5, 4)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1040)}}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_kneser_ney(spark, n):
    """Probabilities after every context, seen or not, add up to 1."""
    rng = random.Random(n)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30)))) for i in range(40)], "doc_id long, text string")
    model = language_model.train(docs, n)
    assert model.n == n and model.words == 12
    contexts = [tuple(rng.choices([*words, "never"], k=n - 1)) for _ in range(20)]
    rows = spark.createDataFrame([(*c, w) for c in {*contexts} for w in words], ", ".join(f"{x} string" for x in language_model.names(n)))
    sums = {}
    for r in language_model.probability(rows, model).collect():
        assert 0 < r["prob"] <= 1
        sums[tuple(r[:-2])] = sums.get(tuple(r[:-2]), 0) + r["prob"]
    assert len(sums) == len({*contexts}) and all(abs(s - 1) < 1e-9 for s in sums.values())
    for r in language_model.perplexity(docs, model).collect():
        assert 1 <= r["perplexity"] < 60


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_spelling_candidates(spark, edits):
    """All pairs within the edits, wrong first letters and words around the length where pieces begin included."""
    rng = random.Random(edits)
    held = {"".join(rng.choices("abé", k=rng.choice([1, 2, 3, 4, 22, 23, 24, 25, 26, 27, 40]))) for _ in range(120)} | {"", "x"}
    sought = set(rng.sample(sorted(held), 60))
    for w in list(sought):
        letters = list(w)
        for _ in range(rng.randint(1, edits + 1)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        sought.add("".join(letters))
    rows = [(w,) for w in sought] + [(None,), ("a",)]
    got = {tuple(r) for r in spelling.candidates(spark.createDataFrame(rows, "word string"), spark.createDataFrame([(w,) for w in held] + [(None,)], "word string"), edits).collect()}
    assert got == {(a, b, edit_distance(a, b)) for a in sought | {"a"} for b in held if a and b and a != b and edit_distance(a, b) <= edits}
    vocab = spark.createDataFrame([("hello", 5), ("jello", 9), ("hallo", 9), ("help", 2)], "word string, freq long")
    best = spelling.best(spark.createDataFrame([("gello",)], "word string"), vocab, 2)
    assert [(r["suggestion"], r["rank"]) for r in best.orderBy("rank").collect()] == [("jello", 1), ("hello", 2)]
    known = spelling.known_phrases(spark.createDataFrame([("New  York", 1), ("old york", 2)], "phrase string, n int"), spark.createDataFrame([("new york",), ("NEW YORK",)], "phrase string"))
    assert [tuple(r) for r in known.collect()] == [("New  York", 1)]


def test_map_file_marks(spark, tmp_path):
    odd = ["a\\tb", "tab\there", "line\nend", "\x01", "\\", "\\\\n", "end\\", "\\\t\n\\n", "é"]
    path = str(tmp_path / "map")
    io.save_map(spark.createDataFrame([(x, y) for x in odd for y in odd], "key string, value string"), path)
    assert {tuple(r) for r in io.load_map(spark, path).collect()} == {(x, y) for x in odd for y in odd}


def test_replacement_recovers(spark, tmp_path):
    """A replacement that ended between its renames leaves the old table to be put back."""
    import shutil

    path = str(tmp_path / "t")
    count = lambda p=path: spark.read.parquet(p).count()
    for n in (1, 2, 3):
        io.replace_table(spark.range(n), path)
        assert count() == n
    assert count(path + ".bak") == 2
    shutil.move(path, path + ".old")
    assert io.recover_table(spark, path) and count() == 3 and not io.recover_table(spark, path)
    shutil.copytree(path, path + ".old")
    assert not io.recover_table(spark, path) and count() == 3 and count(path + ".bak") == 3
    shutil.move(path, path + ".old")
    io.replace_table(spark.range(4), path, backup=False)
    assert count() == 4


def test_optics(spark):
    """Cuts are what DBSCAN finds at each epsilon; clusters stand together in the order; noise comes last."""
    rng = np.random.default_rng(12)
    heads = rng.normal(size=(6, 3)) * 6
    points = np.vstack([heads[rng.integers(6, size=120)] + rng.normal(size=(120, 3)), rng.uniform(-15, 15, size=(30, 3)), np.repeat(heads[:1], 4, axis=0)])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<double>")
    for least, steps in ((1, (1.3,)), (4, (1.3, 2.5))):
        o = cluster.Options(method="optics", measure="euclidean", epsilon=2.5, min_points=least)
        found = cluster.optics(rows, o)
        for epsilon in steps:
            want = {tuple(r) for r in cluster.dbscan(rows, cluster.Options(method="dbscan", measure="euclidean", epsilon=epsilon, min_points=least)).collect()}
            assert {tuple(r) for r in cluster.optics_cut(found, epsilon).collect()} == want
    order = [tuple(r) for r in cluster.optics_order(found, [1.3, 2.5]).orderBy("place").collect()]
    assert [p for p, _, _ in order] == list(range(len(points)))
    for epsilon in (1.3, 2.5):
        label = {r["vec_id"]: r["cluster"] for r in cluster.optics_cut(found, epsilon).collect()}
        runs = [label[v] for _, v, _ in order if label[v] is not None]
        assert sum(a != b for a, b in zip(runs, runs[1:])) == len(set(runs)) - 1
        assert all((reach is not None and reach <= epsilon) == (label[v] is not None and label[v] == label[w]) for (_, w, _), (_, v, reach) in zip(order, order[1:]))
    with pytest.raises(ValueError):
        cluster.optics_cut(found, 3.0)


def test_merged_fold(spark):
    """States of groups of any size, over several levels of merging."""
    from textloom.operators import relations

    rows = spark.range(20_000).selectExpr("id % 3 as k", "id as x").repartition(150)
    start = lambda: {"n": 0, "top": []}
    add = lambda s, r: {"n": s["n"] + 1, "top": sorted([*s["top"], r["x"]])[-3:]}
    merge = lambda a, b: {"n": a["n"] + b["n"], "top": sorted([*a["top"], *b["top"]])[-3:]}
    got = relations.merge_fold(rows, ["k"], "n long, top array<long>", start, add, merge, held=2)
    assert {(r["k"], r["n"], tuple(r["top"])) for r in got.collect()} == {(k, len(range(k, 20_000, 3)), tuple(range(k, 20_000, 3)[-3:])) for k in range(3)}
    assert relations.merge_fold(rows.limit(0), ["k"], "n long, top array<long>", start, add, merge).count() == 0
    names = relations.match_names(spark.createDataFrame([("a",), ("AB",), ("abc",), ("x",)], "word string"), spark.createDataFrame([("ab",), ("abc",)], "name string"))
    assert {(r["word"], r["match"], tuple(r["all"])) for r in names.collect()} == {("a", None, ("ab", "abc")), ("AB", "ab", ("ab", "abc")), ("abc", "abc", ("abc",)), ("x", None, ())}


def test_table_function(spark):
    """Words of the table function are those of the array form; a splitter of the caller's works too."""
    from pyspark.sql import functions as F

    from textloom.functions import tokenize

    texts = ["Hello, world! don't re-use 1,234.56", "", None, "N.A.T.O. met -- today."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in tokenize.token_table(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["word"]))
    want = {r["doc_id"]: list(enumerate(r["w"])) for r in rows.select("doc_id", tokenize.english(F.col("text")).alias("w")).collect() if r["w"]}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert {r["word"] for r in tokenize.token_table(rows, lambda t: t.split("o")).filter("doc_id = 3").collect()} == {"N.A.T.O. met -- t", "day."}
    with pytest.raises(Exception, match="a text is wanted"):
        tokenize.token_table(rows, text="doc_id").collect()


def test_growing_vocabulary(spark, tmp_path):
    """One number a word whatever the batches are; a batch that runs again changes nothing."""
    from textloom.streaming import vocabulary

    path, batches = str(tmp_path / "v"), [["b", "a", "b"], ["a", "c", None], [], ["d", "b", "e"]]
    add = vocabulary.find_or_add(path)
    frames = [spark.createDataFrame([(w,) for w in b], "word string") for b in batches]
    for k, frame in enumerate(frames):
        add(frame, k)
    want = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    held = lambda: {r["word"]: r["id"] for r in vocabulary.read_vocabulary(spark, path).collect()}
    assert held() == want
    for k in (1, 3):
        add(frames[k], k)
    assert held() == want and vocabulary.read_vocabulary(spark, path).count() == 5
