"""Lists, sets, maps and bit vectors as array and map expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def member(a: Column, x) -> Column:
    return F.array_contains(a, x)


def remove_if(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: ~test(x))


def keep_if(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(a, test)


def subsequence(a: Column, start: int, stop: int) -> Column:
    """Elements start to stop - 1, from 0."""
    return F.slice(a, start + 1, max(0, stop - start))


def elide(a: Column, start: int, stop: int) -> Column:
    """Without the elements start to stop - 1."""
    return F.concat(F.slice(a, 1, start), F.slice(a, F.lit(stop + 1), F.greatest(F.size(a) - stop, F.lit(0))))


def nth(a: Column, n: int) -> Column:
    return F.get(a, F.lit(n))


def tail_from(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def resize(a: Column, n: int, fill) -> Column:
    """Exactly n elements: cut, or filled up."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), n)), 1, n)


def without_nulls(a: Column) -> Column:
    return F.array_compact(a)


def pushed(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def prepended(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def popped(a: Column) -> Column:
    """Struct (rest, item): without the last element, and that element; an empty list gives itself and null."""
    rest = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.struct(rest.alias("rest"), last(a).alias("item"))


def extended(a: Column, x: Column, times: int = 1) -> Column:
    """With a value at the end so many times."""
    return F.concat(a, F.array_repeat(x, times))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: lists or bit vectors by their first difference, then by length; null if either is null."""
    n = F.size(a)
    m = F.size(b)
    short = F.least(n, m)
    signs = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0))
    inside = F.filter(signs, lambda d: d != 0)
    by_length = F.when(n < m, -1).when(n > m, 1).otherwise(0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(F.get(inside, F.lit(0)), by_length))


def assoc(pairs: Column, key) -> Column:
    """The value of the first pair (key, value) with the key; null without one."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["value"]


def bits(s: Column) -> Column:
    """A "0110" literal as an array of booleans."""
    return F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: x == "1")


def set_bit(a: Column, n: int, value: bool) -> Column:
    return F.transform(a, lambda x, i: F.when(i == n, F.lit(value)).otherwise(x))


def with_property(m: Column, key: str, value: Column) -> Column:
    """A map with the key set to the value."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def generated_symbol(base: str, n: Column) -> Column:
    return F.format_string(f"{base}%d", n)
