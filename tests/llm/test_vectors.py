"""Whitening and hard negatives against plain restatements."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from textloom.llm import negatives, whitening

FIELDS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def brute_whitening(rows, most=32):
    """(vec_id, deviation, whitened...) of each usable row, eigenvalues and n, in plain numpy on the driver."""
    kept = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in kept], ((n * x - sums) ** 2).sum(axis=1), y @ vectors[:, :most] / np.sqrt(values[:most]), values


def test_whitening(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.op13_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in table.collect())
    ids, deviation, whitened, values = brute_whitening(rows)
    assert len(got) == 32 * len(rows) and list(got["vec_id"][::32]) == ids and (got["n"] == len(rows)).all()
    assert list(got["deviation"][::32]) == deviation.tolist()
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 32)), np.abs(whitened), atol=1e-9)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32), values[:32] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def odd_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], i % 3) for i in range(60)]
    rows += [(60, None, 1), (61, [1.0, None, 0.0, 0.0, 0.0], 1), (62, [NAN] * 5, 1), (63, [INF, 0.0, 0.0, 0.0, 0.0], 2), (64, [], 1)]
    return rows + [(None, [0.5] * 5, 1), (7, rows[7][1], 1), (8, rows[8][1], None)]


def test_odd_whitening(spark):
    from pyspark.sql import functions as F

    rows = odd_vectors()
    df = spark.createDataFrame(rows, FIELDS).withColumn("x", F.lit("clash")).withColumn("deviation", F.lit("clash"))
    got = whitening.whiten(df).toPandas()
    ids, deviation, whitened, values = brute_whitening(rows)
    assert len(got) == 5 * 63 and sorted(got["deviation"]) == sorted(np.repeat(deviation, 5)) and got["vec_id"].isna().sum() == 5
    assert np.allclose(np.sort(np.abs(got["whitened"])), np.sort(np.abs(whitened.ravel())), atol=1e-9)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 60")).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1)], FIELDS))


def test_whitening_without_variance(spark):
    """Fewer rows than dimensions, and rows that are all alike: components without variance are 0."""
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 1)], FIELDS)).toPandas()
    assert sorted(np.round(np.abs(got["whitened"]), 9)) == [0, 0, 0, 0, 1, 1] and got["identity_error"].iloc[0] < 1e-9
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, FIELDS)).toPandas()
    assert len(got) == 6 and not got["whitened"].any() and not got["explained"].any()


def test_exact_sums(spark):
    """Longs where doubles would not be exact, several passes where there are many pairs."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-(2**22), 2**22)) for _ in range(6)], 0) for i in range(200)]
    got = whitening.fit(whitening.whole_numbers(spark.createDataFrame(rows, FIELDS)))
    _, _, _, values = brute_whitening(rows)
    assert np.allclose(got.eigenvalues, values, rtol=1e-9)
    wide = spark.createDataFrame([(i, [float(rng.randint(-9, 9)) for _ in range(95)], 0) for i in range(120)], FIELDS)
    columns = whitening.columns_of(whitening.whole_numbers(wide), "x", 95, [1_000_000] * 95, "long")
    x = np.array([r["x"] for r in whitening.whole_numbers(wide).collect()]) - 1_000_000
    sums, products = whitening.pair_sums(columns)
    assert sums == x.sum(axis=0).tolist() and (products == x.T @ x).all()


def brute_negatives(rows, every=100, positives=5, most=5):
    """All rows against each anchor, by sorting."""
    held = [(i, v, n) for i, v, n in rows if i is not None and n is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    held = [(i, [math.floor(256 * float(np.float32(c))) for c in v], (n + 1) % 10 if i % 7 == 0 else n) for i, v, n in held]
    out = []
    for a, x, label in held:
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, n == label) for i, y, n in held if i != a]
        for p, positive, _ in sorted(s for s in scores if s[2])[:positives]:
            found = sorted((s, i) for s, i, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p)[:most]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def test_hard_negatives(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, negatives.op12_hard_negatives(spark, sf).collect())) == brute_negatives(rows)


def test_odd_negatives(spark):
    """Ties, repeated rows and ids, nulls, odd entries, clashing names, several blocks and small trees."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    some = [[float(rng.randint(-1, 2)) for _ in range(4)] for _ in range(12)]
    rows = [(rng.choice([rng.randrange(300), 100 * rng.randrange(9)]), rng.choice(some), rng.randrange(3)) for _ in range(400)]
    rows += [(None, some[0], 1), (500, None, 1), (501, some[1], None), (502, [NAN] * 4, 1), (503, [1.0, None, 1.0, 1.0], 0), (504, [INF] * 4, 0), (505, [], 2)]
    df = spark.createDataFrame(rows, FIELDS).repartition(3).withColumn("rank", F.lit("clash")).withColumn("x", F.lit("clash"))
    want = brute_negatives(rows)
    assert len(want) > 300
    for block in (4096, 7):
        assert sorted(map(tuple, negatives.mine(df, block=block).collect())) == want
    assert negatives.mine(df.limit(0)).count() == 0 and negatives.mine(df.filter("vec_id = 501")).count() == 0
    assert negatives.mine(df.filter("vec_id % 100 <> 0")).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(100, [1.0, 2.0], 1), (2, [1.0], 1)], FIELDS)).count()


def test_dual_tree():
    """On rows in clusters most pairs are never scored, and what is found is what brute force finds, large numbers included."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 200
    x = np.floor(centres[rng.integers(30, size=6000)] + rng.normal(size=(6000, 16)) * 4).astype(np.int64)
    ids, labels = np.arange(6000), rng.integers(3, size=6000)
    for scale in (1, 2**18):
        own = negatives.build(ids[:200], labels[:200], x[:200] * scale, leaf=4)
        tree = negatives.build(ids, labels, x * scale, leaf=64)
        assert sorted(tree.ids) == list(range(6000)) and all(np.linalg.norm(tree.x[a:b] - c, axis=1).max(initial=0) <= r for a, b, c, r in zip(tree.start, tree.stop, tree.centre, tree.radius, strict=True))
        best = negatives.Best(np.full(200, np.iinfo(np.int64).min), np.full(200, np.iinfo(np.int64).max), 5)
        negatives.search(own, own, best, 1, True)
        best = negatives.Best(best.least, best.high, 5)
        scored = negatives.search(own, tree, best, 1, True)
        found = sorted((int(w), -int(s), int(i)) for w, s, i in zip(best.want, best.scores, best.ids, strict=True))
        want = []
        for w in range(200):
            scores = sorted((-int(s), i) for s, i, n in zip((tree.x @ own.x[w]).tolist(), tree.ids.tolist(), tree.labels, strict=True) if n == own.labels[w] and i != own.ids[w])[:5]
            want += [(w, s, i) for s, i in scores]
        assert found == sorted(want)
        assert scored < 0.35 * 200 * 6000
    with pytest.raises(ValueError):
        negatives.scores_of(np.full((1, 4), 2**40), np.full((1, 4), 2**40))
