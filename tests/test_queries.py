"""All queries with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import os

import pytest

from textloom.functions import measures
from textloom.operators.tables import materialize
from textloom.plans import catalog
from textloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    held = duckdb.connect()
    for f in os.listdir(SF):
        held.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return held


def same(duck, name, out):
    wanted = duck.execute(ORACLES[name])
    columns = ", ".join(f'"{c}"' for c in sorted(d[0] for d in wanted.description))
    a = duck.execute(f"SELECT {columns} FROM ({ORACLES[name]}) ORDER BY ALL").fetchall()
    return a == duck.execute(f"SELECT {columns} FROM '{out}' ORDER BY ALL").fetchall()


#: Queries of one measure each, of which the pairs are compared in one job.
MEASURE_QUERIES = {f"vec_{m.name}": m for m in measures.MEASURES.values()}


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in MEASURE_QUERIES] + ["vec_cosine", "vec_binary_gamma"])
def test_query(spark, duck, tmp_path, name):
    out = str(tmp_path / "out")
    QUERIES[name](spark, SF).write.parquet(out)
    assert same(duck, name, f"{out}/*.parquet")


def test_measures(spark, duck, tmp_path):
    """All measures over their pairs of vectors, each against its own SQL."""
    wrong = []
    for source in (catalog.nation_profile, catalog.nation_day):
        some = [n for n, m in MEASURE_QUERIES.items() if (m.family == "binary") == (source is catalog.nation_day)]
        pairs = materialize(catalog.pairs(source(spark, SF)), "pairs")
        for k in range(0, len(some), 12):
            names = some[k : k + 12]
            out = tmp_path / f"{source.__name__}{k}.parquet"
            pairs.select("id1", "id2", *[catalog.tidy(measures.measure(MEASURE_QUERIES[n].name, "v1", "v2")).alias(n) for n in names]).toPandas().to_parquet(out)
            for n in names:
                a = duck.execute(f"SELECT id1, id2, value FROM ({ORACLES[n]}) ORDER BY ALL").fetchall()
                if a != duck.execute(f'SELECT id1, id2, "{n}" FROM \'{out}\' ORDER BY ALL').fetchall():
                    wrong.append(n)
    assert wrong == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_without_a_session():
    """The queries' names can be read where no session is active."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
