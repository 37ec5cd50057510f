from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import measures as M

X, Y = [1.0, 0.0, 2.0, 3.0, 0.0], [0.0, 1.0, 2.0, 1.0, 0.0]

# Derived by hand from the formulas for the pair above.
GOLDEN = {
    "benini": -0.75, "braun_blanquet": 0.5, "bray_curtis": 0.4, "cody": 0.625, "dice": 0.6, "fager_mcgowan": 0.882618,
    "gilbert": -0.12, "gini": -0.144841, "harrison": 0.166667, "jaccard": 0.428571, "kulczynski1": 0.75, "lennon2": 0.514573,
    "magurran": 5.714286, "modified_gini": -0.166667, "routledge1": 0.139535, "routledge2": 0.257123, "tripartite": 0.567258,
    "williams2": 0.166667, "binary_benini": 0.166667, "binary_gamma": 0.333333, "binary_sokal_sneath": 0.75,
    "binary_tripartite": 0.700881, "cosine": 0.763763, "canberra": 0.4, "soergel": 0.571429, "lorentzian": 2.484907,
    "clark": 1.5, "wave_hedges": 2.666667, "sangvi": 1.732051, "circle_product": 0.3, "similarity_ratio": 0.538462,
    "robinson": 0.416667, "jensen": 0.174033, "jensen_shannon": 0.251076, "kullback_leibler": 0.305012, "l0": 0.6,
    "bhattacharyya": 0.272069, "hellinger": 0.976111, "matusita": 0.690215, "squared_chord": 2.535898,
}


def values(spark, x, y, names):
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    return dict(zip(names, df.select(*[M.measure(n, "x", "y").alias(n) for n in names]).first(), strict=True))


def test_golden(spark):
    got = values(spark, X, Y, list(GOLDEN))
    assert {k: round(v, 6) for k, v in got.items()} == pytest.approx(GOLDEN, abs=2e-6)


def test_power_and_parameters(spark):
    df = spark.createDataFrame([(X, Y)], "x array<double>, y array<double>")
    row = df.select(M.l_norm("x", "y", 3), M.l_norm("x", "y", 0), M.tversky("x", "y", 1.0, 1.0), M.measure("jaccard", "x", "y")).first()
    assert row[0] == pytest.approx(2.154435, abs=1e-6)
    assert row[1] == 2
    assert row[2] == pytest.approx(row[3])


def test_identities(spark):
    got = values(spark, X, Y, list(M.MEASURES))
    assert got["dice"] == pytest.approx(2 * got["jaccard"] / (1 + got["jaccard"]))
    assert got["ochiai"] ** 2 == pytest.approx(got["sorgenfrei"])
    assert got["squared_euclidean"] == pytest.approx(got["euclidean"] ** 2)
    assert len({round(got[k], 9) for k in ("bray_curtis", "cocogaston", "lance_williams", "wilson_shmida")}) == 1
    assert got["bray_curtis"] == pytest.approx(1 - got["dice"])


def test_empty_and_zero_vectors(spark):
    for x, y in (([0.0] * 3, [0.0] * 3), ([], []), ([1.0, 0.0, 0.0], [0.0] * 3)):
        got = values(spark, x, y, list(M.MEASURES))
        assert all(v is not None and not math.isnan(v) for v in got.values())
    assert values(spark, [0.0], [0.0], ["cosine", "dice"]) == {"cosine": 0, "dice": 1}


def test_names():
    assert M.find_measure("COS").name == "cosine"
    assert M.find_measure("tanimoto").name == "similarity_ratio"
    with pytest.raises(KeyError):
        M.find_measure("binary_b")
    with pytest.raises(KeyError):
        M.find_measure("nothing")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=6))
def test_ranges_and_symmetry(spark, cells):
    x, y = [float(a) for a, _ in cells], [float(b) for _, b in cells]
    names = ["dice", "jaccard", "simpson", "ochiai", "bray_curtis", "whittaker"]
    there, back = values(spark, x, y, names), values(spark, y, x, names)
    for n in names:
        assert there[n] == pytest.approx(back[n])
        assert -1e-9 <= there[n] <= 1 + 1e-9
