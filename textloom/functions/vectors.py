"""Vector algebra on arrays of doubles and on sparse maps index -> value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def weight_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))


def largest_weight(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))


def add(a: Column, b: Column, weight: float = 1.0) -> Column:
    """a + weight * b; the shorter one is padded with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) * F.lit(float(weight)))


def increase(a: Column, b: Column, weight: float = 1.0) -> Column:
    """a + weight * b over the positions that both have; a's other positions stay."""
    return F.zip_with(a, F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(0))), lambda x, y: x + F.coalesce(y, F.lit(0.0)) * F.lit(float(weight)))


def scale(v: Column, factor: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(float(factor)))


def normalize(v: Column) -> Column:
    """Over its Euclidean length; the zero vector stays."""
    n = length(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def sparse_add(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) * F.lit(float(weight)))


def sparse_insert(v: Column, index: int, value: float) -> Column:
    """With a new element; unchanged if the index is there already."""
    return F.when(F.map_contains_key(v, F.lit(index)), v).otherwise(F.map_concat(v, F.create_map(F.lit(index), F.lit(float(value)))))


def sparse_to_dense(v: Column, dims: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at(v, i), F.lit(0.0)))


def index_union(a: Column, b: Column) -> Column:
    return F.size(F.array_union(F.map_keys(a), F.map_keys(b)))


def basis(term: Column, dims: int, seed: int = 0) -> Column:
    """A random vector of -1, 0 and +1, half of it zero on average, that follows from the term alone."""
    draw = lambda i: T.digest_number(F.concat_ws(":", term.cast("string"), i.cast("string"), F.lit(str(seed)))) % 4
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(draw(i) == 0, 1.0).when(draw(i) == 1, -1.0).otherwise(0.0))


def one_hot(at: Column, dims: int) -> Column:
    """A vector of so many zeros with a one at a place from 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (i == at).cast("double"))


def parse_dense(line: Column) -> Column:
    """ "v v v ..." as an array of doubles."""
    return F.transform(F.filter(F.split(line, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def parse_sparse(line: Column) -> Column:
    """ "i:v i:v ..." as a map."""
    cells = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    pairs = F.transform(cells, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int"), F.split_part(x, F.lit(":"), F.lit(2)).cast("double")))
    return F.map_from_entries(pairs)


def parse_term_vector(literal: Column) -> Column:
    """The i:v cells of a "#<TermVector:... i:v i:v>" literal as a map."""
    cells = F.regexp_extract_all(literal, F.lit(r"(?<=\s)([0-9]+:[-+0-9.eE]+)"), F.lit(1))
    return F.map_from_entries(F.transform(cells, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int"), F.split_part(x, F.lit(":"), F.lit(2)).cast("double"))))
