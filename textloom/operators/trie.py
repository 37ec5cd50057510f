"""Prefix trees as prefix tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, prefix): every proper and whole prefix of each key; the empty key has none."""
    n = F.length(key)
    spans = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(key), F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    return keys.select(key, F.explode(spans).alias("prefix"))


def nodes(keys: DataFrame, key: str = "key") -> DataFrame:
    """(prefix, keys): the nodes of the trie below its root, and how many distinct keys run through each."""
    return prefixes(keys.select(key).distinct(), key).groupBy("prefix").agg(F.count("*").alias("keys"))


def terminal(keys: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys that no other key extends."""
    own = keys.select(key).distinct()
    longer = prefixes(own, key).filter(F.col("prefix") != F.col(key)).select(F.col("prefix").alias(key)).distinct()
    return own.join(longer, key, "left_anti")


def find(keys: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(wanted.select(key).distinct(), key, "left_semi")


def extensions(keys: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """(prefix, key): of each wanted prefix the distinct keys that start with it."""
    return prefixes(keys.select(key).distinct(), key).join(wanted.select("prefix").distinct(), "prefix").select("prefix", key)


def steps(keys: DataFrame, key: str = "key") -> DataFrame:
    """(prefix, step, node): the edges of the trie; the root is the empty prefix."""
    own = nodes(keys, key).select(F.col("prefix").alias("node"))
    return own.select(F.expr("substring(node, 1, length(node) - 1)").alias("prefix"), F.expr("right(node, 1)").alias("step"), "node")
