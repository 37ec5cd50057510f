"""Whitening of embeddings by upper-triangle column aggregates.

Entries become whole numbers x = floor(64 * c) + 1,000,000. One pass sums each dimension.
A second one runs a generated Spark SQL aggregation: for every pair of dimensions i <= j
the sum of d_i * d_j, where d is x less the rounded mean of its dimension, so products are
centred before they are multiplied, small, and summed exactly: as doubles while rows times
the square of the entries' range stay under 2^53, else as longs. The covariance
follows from these sums in exact rational numbers and is rounded once to doubles; LAPACK
(eigh) decomposes it. Rows are projected in Arrow batches and never move. A third
aggregation of the same form over the whitened rows measures how far their covariance is
from the identity.

Aggregations have ``PAIRS_AT_ONCE`` pairs at most; up to 90 dimensions all pairs are in one,
more dimensions take several passes. Partial sums are combined before the shuffle, of
which one row of sums is left.

Defined results: rows whose vector is null or holds a null or non-finite entry are left
out; so are empty vectors. Vectors of more than one length raise ValueError. Repeated rows
count apart, and a null vec_id is carried along. Components have falling eigenvalues; the
entry of a component with the largest absolute value is positive, for the same signs on
every run. A component without variance (an eigenvalue of at most 1e-12 of the trace, as
with fewer rows than dimensions) has whitened 0 and stays out of identity_error. Other
columns are ignored. No rows give no rows. Numbers that leave the range of a long raise an
error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import parts_of, read_table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
PAIRS_AT_ONCE = 4096
#: Share of the trace at and below which an eigenvalue counts as zero.
NO_VARIANCE = 1e-12

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vectors have finite entries only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is larger than any number
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & finite)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def columns_of(rows: DataFrame, array: str, size: int, less: list[int] | None = None, kind: str = "double") -> DataFrame:
    """One column d0, d1, ... for each entry of the array, less a number of its own; none is null."""
    entry = lambda i: F.get(array, F.lit(i)) - F.lit(less[i]) if less else F.get(array, F.lit(i))
    return rows.select(*[F.coalesce(entry(i).cast(kind), F.lit(0).cast(kind)).alias(f"d{i}") for i in range(size)])


def pair_sums(columns: DataFrame) -> tuple[list, np.ndarray]:
    """The sums of the columns d0, d1, ... and of the products of every two of them, as a list and a symmetric matrix of Python numbers."""
    size = len(columns.columns)
    wanted: list[tuple[int, int]] = [(i, j) for i in range(size) for j in range(i, size)]
    single = columns.agg(*[F.sum(f"d{i}") for i in range(size)]) if len(wanted) > PAIRS_AT_ONCE else None
    sums, out = list(single.first()) if single is not None else [], np.zeros((size, size), dtype=object)
    for k in range(0, len(wanted), PAIRS_AT_ONCE):
        some = wanted[k : k + PAIRS_AT_ONCE]
        alone = [] if single is not None else [f"sum(d{i}) AS s{i}" for i in range(size)]
        row = columns.selectExpr(*alone, *[f"sum(d{i} * d{j}) AS p{i}_{j}" for i, j in some]).first()  # one row of sums
        sums = sums or list(row[: len(alone)])
        for (i, j), value in zip(some, row[len(alone) :], strict=True):
            out[i, j] = out[j, i] = value
    return sums, out


@dataclass(frozen=True)
class Whitening:
    """What is fitted: rows, sums of the dimensions, eigenvalues and unit eigenvectors (columns) by falling eigenvalue, trace."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.eigenvalues > NO_VARIANCE * self.trace

    def explained(self) -> np.ndarray:
        return np.maximum(self.eigenvalues, 0) / self.trace if self.trace else np.zeros(len(self.eigenvalues))


def covariance(n: int, sums: list, products: np.ndarray) -> np.ndarray:
    """From exact sums of shifted whole numbers: (n * products - sums sums') / n^2, rounded once."""
    size, sums = len(sums), [int(x) for x in sums]
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = float(Fraction(n * int(products[i, j]) - sums[i] * sums[j], n * n))
    return out


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of whole-number vectors (x); None without rows."""
    first = rows.select(F.size("x")).first()
    if first is None:
        return None
    size = first[0]
    checked = F.when(F.size("x") == size, F.col("x"))
    sizes = [F.count("*"), F.count("x"), F.min(F.array_min("x")), F.max(F.array_max("x"))]
    facts = rows.select(checked.alias("x")).agg(*sizes, *[F.sum(F.get("x", F.lit(i))) for i in range(size)]).first()
    n, whole, least, most, *sums = facts
    if n != whole:
        raise ValueError(f"{n - whole} of {n} vectors have another length than {size}")
    centre = [round(Fraction(s, n)) for s in sums]
    small = n * (most - least + 1) ** 2 < 2**53
    left, products = pair_sums(columns_of(rows, "x", size, centre, "double" if small else "long"))
    v = covariance(n, left, products)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(size)]
    return Whitening(n, tuple(sums), values, vectors * np.where(lead < 0, -1.0, 1.0), float(np.trace(v)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _projected(model: Whitening, most: int):
    """From a matrix x of longs: deviations and whitened numbers."""
    k = min(most, len(model.sums))
    scale = np.where(model.live[:k], 1 / np.sqrt(np.where(model.live[:k], model.eigenvalues[:k], 1.0)), 0.0)
    axes = model.components[:, :k] * scale
    sums = np.array(model.sums, dtype=np.int64)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = x * np.int64(model.n) - sums
        top = max(int(far.max(initial=0)), -int(far.min(initial=0)))
        if top * top * len(sums) < 2**63:
            deviation = np.einsum("ij,ij->i", far, far)
        else:
            deviation = np.array([sum(int(c) ** 2 for c in row) for row in far], dtype=object)
        return deviation, (far / model.n) @ axes

    return run


def whitened_rows(rows: DataFrame, model: Whitening, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, y): the exact deviation and the whitened components of each row."""
    project = _projected(model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch, 4096)):
            deviation, y = project(_matrix(part.column(1)))
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation.tolist(), pa.int64()), lists], names=["vec_id", "deviation", "y"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, y array<double>")


def identity_error(whitened: DataFrame, model: Whitening, most: int = COMPONENTS) -> float:
    """The largest absolute entry of the measured covariance of y less the identity, over components that have a variance."""
    k = min(most, len(model.sums))
    sums, products = pair_sums(columns_of(whitened, "y", k))
    means = np.array(sums, dtype=float) / model.n
    gap = np.abs(products.astype(float) / model.n - np.outer(means, means) - np.eye(k))
    live = model.live[:k]
    return float(gap[np.ix_(live, live)].max(initial=0.0))


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """SCHEMA: one row for each vector and component."""
    rows = whole_numbers(embeddings)
    model = fit(rows)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    made = whitened_rows(rows, model, most)
    error = identity_error(made, model, most)
    share = F.array(*[F.lit(float(x)) for x in model.explained()[:most]])
    cells = made.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return cells.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
