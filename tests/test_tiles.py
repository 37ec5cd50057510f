"""Searches of vectors in tiles: what a task holds stays bounded, and results are those of brute force."""

from __future__ import annotations

import numpy as np

from textloom.operators import cluster


def vectors(spark, n: int = 60, clusters: int = 4, seed: int = 5):
    """Vectors with a zero vector, equal ones and, in some, a null; (vec_id, cluster, v) and the unit rows."""
    m = np.random.default_rng(seed).normal(size=(n, 6))
    m[7], m[9] = 0.0, m[8]
    rows = spark.createDataFrame([(i, i % clusters, x.tolist()) for i, x in enumerate(m)], "vec_id long, cluster long, v array<double>")
    return rows, cluster._unit(m)


def test_within_is_a_matrix_product(spark, monkeypatch):
    """dbscan_clusters: no join of vectors by expressions; zero vectors, nulls, tiles of a few numbers."""
    monkeypatch.setattr(cluster, "TILE_CELLS", 40)
    rows, unit = vectors(spark)
    rows = rows.unionByName(spark.createDataFrame([(1000, 0, None)], rows.schema))
    for epsilon in (0.3, 1.0):
        found = cluster.within(rows, epsilon)
        assert "Join" not in found._jdf.queryExecution().toString() and "MapInArrow" in found._jdf.queryExecution().toString()
        dist = 1 - unit @ unit.T
        want = {(i, j) for i in range(60) for j in range(60) if i != j and dist[i, j] <= epsilon + 1e-12}
        got = found.collect()
        assert len(got) == len(want) and {(r["vec_id"], r["other"]) for r in got} == want
        assert all(abs(r["dist"] - dist[r["vec_id"], r["other"]]) < 1e-9 for r in got)


def test_optics_cuts_like_dbscan(spark, monkeypatch):
    """optics_cuts: blocks of a few vectors, whose pairs are found once, give the clusters of one search."""
    rows, _ = vectors(spark)
    monkeypatch.setattr(cluster, "MAX_CENTRE_CELLS", 90)
    found = cluster.optics(rows.select("vec_id", "v"), cluster.Options(epsilon=0.4, min_points=3))
    assert found.near.select("vec_id", "other").distinct().count() == found.near.count()
    monkeypatch.undo()
    for epsilon in (0.2, 0.4):
        cut = sorted(map(str, cluster.optics_cut(found, epsilon).collect()))
        assert cut == sorted(map(str, cluster.dbscan(rows.select("vec_id", "v"), cluster.Options(epsilon=epsilon, min_points=3)).collect()))


def searched(spark, monkeypatch, queries: int, k: int) -> tuple[list, list[int]]:
    """A search's own function over one batch in this process: what it finds, and the sizes of its tiles."""
    rows, _ = vectors(spark)
    sizes, held, merge = [], [], cluster.merge_best
    with monkeypatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda self, run, schema: held.append(run))
        cluster._ranked_in_block(rows.filter(f"vec_id < {queries}").selectExpr("vec_id AS query", "v"), rows, k, "cosine")
    monkeypatch.setattr(cluster, "merge_best", lambda best, ids, own, sims: (sizes.append(sims.size), merge(best, ids, own, sims)))
    batch = rows.select("vec_id", "v").orderBy("vec_id").toArrow().combine_chunks().to_batches()[0]
    return [(r["query"], r["vec_id"]) for part in held[0](iter([batch])) for r in part.to_pylist()], sizes


def brute(unit: np.ndarray, queries: int, k: int) -> list:
    sims = np.round(unit @ unit.T, 12)
    return [(q, i) for q in range(queries) for i in sorted((i for i in range(len(unit)) if i != q), key=lambda i: (-sims[q, i], i))[:k]]


def test_shared_neighbours_holds_tiles(spark, monkeypatch):
    """shared_neighbours: all vectors against a batch of all, of which a task holds no more than a tile."""
    monkeypatch.setattr(cluster, "TILE_CELLS", 600)
    got, sizes = searched(spark, monkeypatch, 60, 5)
    assert sorted(got) == sorted(brute(vectors(spark)[1], 60, 5)) and max(sizes) <= 600


def test_knn_topk_holds_tiles(spark, monkeypatch):
    """knn_topk: a few queries and pieces of a batch of fewer vectors than a query's best."""
    monkeypatch.setattr(cluster, "TILE_CELLS", 30)
    got, sizes = searched(spark, monkeypatch, 6, 10)
    assert sorted(got) == sorted(brute(vectors(spark)[1], 6, 10)) and max(sizes) <= 30


def test_knn_top1_holds_tiles(spark, monkeypatch):
    """knn_top1: queries in several tiles too."""
    monkeypatch.setattr(cluster, "TILE_CELLS", 16)
    monkeypatch.setattr(cluster, "QUERY_TILE", 4)
    got, sizes = searched(spark, monkeypatch, 10, 1)
    assert sorted(got) == sorted(brute(vectors(spark)[1], 10, 1)) and max(sizes) <= 16


def linked(spark, monkeypatch, how: str) -> None:
    """A linkage's own function over one batch: bounded tiles, results given before all clusters are held, and brute force."""
    rows, unit = vectors(spark, clusters=20)
    monkeypatch.setattr(cluster, "TILE_CELLS", 180)
    held, sizes = [], []
    with monkeypatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda self, run, schema: held.append(run))
        cluster._linked_in_block(rows, rows, how)
    plain = cluster._tiles
    monkeypatch.setattr(cluster, "_tiles", lambda batches, width: ((sizes.append(len(x) * width), (own, x))[1] for own, x in plain(batches, width)))
    batch = rows.select("cluster", "v").toArrow().combine_chunks().to_batches()[0]
    parts = [r for part in held[0](iter([batch])) for r in part.to_pylist()]
    assert max(sizes) <= 180
    best = max if how == "max" else min
    got, want = {}, {}
    for r in parts:
        got[r["c1"], r["c2"]] = best(got.get((r["c1"], r["c2"]), r["sim"]), r["sim"])
    for i, x in enumerate(unit):
        for j, y in enumerate(unit):
            if (pair := (i % 20, j % 20))[0] < pair[1]:
                want[pair] = best(want.get(pair, x @ y), x @ y)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_linkage_nearest_holds_tiles(spark, monkeypatch):
    """linkage_nearest"""
    linked(spark, monkeypatch, "max")


def test_linkage_furthest_holds_tiles(spark, monkeypatch):
    """linkage_furthest"""
    linked(spark, monkeypatch, "min")


def distances(spark, monkeypatch, how: str) -> None:
    """Linkage by distance over blocks and tiles of a few numbers, against brute force; the clusters' names are text."""
    rows, unit = vectors(spark)
    monkeypatch.setattr(cluster, "MAX_CENTRE_CELLS", 60)
    named = rows.selectExpr("vec_id", "concat('c', cluster) AS cluster", "v")
    assert cluster.TILE_CELLS > 0
    got = {(r["c1"], r["c2"]): r["dist"] for r in cluster.linkage(named, how, kind="distance").collect()}
    dist, best = 1 - unit @ unit.T, min if how == "nearest" else max
    want = {(f"c{a}", f"c{b}"): best(dist[i, j] for i in range(a, 60, 4) for j in range(b, 60, 4)) for a in range(4) for b in range(a + 1, 4)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_linkage_distance_furthest_in_blocks(spark, monkeypatch):
    """linkage_distance_furthest"""
    distances(spark, monkeypatch, "furthest")


def test_linkage_distance_nearest_in_blocks(spark, monkeypatch):
    """linkage_distance_nearest"""
    distances(spark, monkeypatch, "nearest")


def against(spark, monkeypatch, how: str, reverse: bool = False) -> None:
    """Distances of clusters to vectors: matrix products, in blocks and tiles of a few numbers, with a null vector."""
    monkeypatch.setattr(cluster, "TILE_CELLS", 40)
    monkeypatch.setattr(cluster, "MAX_CENTRE_CELLS", 150)
    rows, unit = vectors(spark)
    all_rows = rows.unionByName(spark.createDataFrame([(1000, 0, None)], rows.schema))
    found = cluster.to_vectors(all_rows, rows.filter("vec_id % 10 < 2"), how, kind="distance", reverse=reverse)
    assert "Join" not in found._jdf.queryExecution().toString()
    got = {(r["cluster"], r["vec_id"]): r["value"] for r in found.collect()}
    dist, of = 1 - unit @ unit.T, {"average": np.mean, "nearest": np.min, "furthest": np.max}[how]
    want = {(c, i): of(dist[c::4, i]) for c in range(4) for i in range(60) if i % 10 < 2}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_vector_distance_furthest_reversed(spark, monkeypatch):
    """vector_distance_furthest_reversed"""
    against(spark, monkeypatch, "furthest", True)


def test_vector_distance_nearest(spark, monkeypatch):
    """vector_distance_nearest"""
    against(spark, monkeypatch, "nearest")


def test_vector_distance_average(spark, monkeypatch):
    """vector_distance_average"""
    against(spark, monkeypatch, "average")


def test_brown_merges_in_tiles(spark, monkeypatch):
    """brown_clusters: the search of its rounds, by inner product over a batch, holds tiles and finds each one's best."""
    rows, _ = vectors(spark)
    monkeypatch.setattr(cluster, "TILE_CELLS", 120)
    held, sizes, merge = [], [], cluster.merge_best
    with monkeypatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda self, run, schema: held.append(run))
        cluster._ranked_in_block(rows.selectExpr("vec_id AS query", "v"), rows, 1, "product")
    monkeypatch.setattr(cluster, "merge_best", lambda best, ids, own, sims: (sizes.append(sims.size), merge(best, ids, own, sims)))
    batch = rows.select("vec_id", "v").toArrow().combine_chunks().to_batches()[0]
    got = {r["query"]: r["vec_id"] for part in held[0](iter([batch])) for r in part.to_pylist()}
    m = np.array(batch.column(1).to_pylist())
    sims = np.round(m @ m.T, 12)
    np.fill_diagonal(sims, -np.inf)
    assert max(sizes) <= 120 and got == {i: int(np.argmax(sims[i])) for i in range(60)}
