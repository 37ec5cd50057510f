"""Hash-table, list and queue operators as joins, aggregates and limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from textloom.operators.tables import discard, materialize


def add_counts(rows: DataFrame, key: list[str], amount: Column | None = None, name: str = "n") -> DataFrame:
    return rows.groupBy(*key).agg((F.count("*") if amount is None else F.sum(amount)).alias(name))


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the first row in the given order, by an aggregate (no sort of a group)."""
    rest = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("textloom_row")).select(key, *[F.col(f"textloom_row.{c}").alias(c) for c in rest])


def probe(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(table, key)


def contained(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(table.select(*key), key, "left_semi")


def removed(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(table.select(*key), key, "left_anti")


def top(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def top_by_group(rows: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group, with rank. Spark limits each task's groups to k rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows picked by a seeded hash of the key: the same rows on every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def sample_share(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About the share of the rows, by a seeded hash of the key; needs no shuffle."""
    mark = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")
    return rows.filter(mark < int(share * (1 << 32)))


def inverse_relation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of a relation, as two rows."""
    return pairs.select(F.col(a).alias("subject"), F.col(b).alias("object"), F.lit(False).alias("inverse")).unionByName(
        pairs.select(F.col(b).alias("subject"), F.col(a).alias("object"), F.lit(True).alias("inverse"))
    )


def change_priority(queue: DataFrame, changes: DataFrame, key: str, priority: str, k: int) -> DataFrame:
    """A bounded queue after some keys got new priorities: the k highest, ties by key."""
    new = changes.select(key, F.col(priority).alias("textloom_new"))
    out = queue.join(new, key, "left").withColumn(priority, F.coalesce("textloom_new", priority)).drop("textloom_new")
    return top(out, k, [F.desc(priority), F.col(key)])


def match_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, match, all): of words (word) the names (name) that a word begins in any case, and the one meant: the name itself, else the only one; else null."""
    low = names.select("name", F.explode(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))).alias("n")).select("name", F.lower(F.substring(F.col("name"), F.lit(1), F.col("n"))).alias("start"))
    met = words.select("word").distinct().withColumn("start", F.lower("word")).join(low.distinct(), "start", "left")
    same = F.collect_list(F.when(F.lower("name") == F.lower("word"), F.col("name")))
    found = met.groupBy("word").agg(F.array_sort(F.collect_list("name")).alias("all"), same.alias("same"))
    only = F.when(F.size("same") == 1, F.get("same", F.lit(0))).when((F.size("same") == 0) & (F.size("all") == 1), F.get("all", F.lit(0)))
    return found.select("word", only.alias("match"), "all")


def fold(rows: DataFrame, key: list[str], order: list[str], start: Column, merge, name: str = "folded") -> DataFrame:
    """(key, folded): a merge of the caller's, (state, row) -> state, over each group's rows in an order; for groups that fit into a row."""
    rest = [c for c in rows.columns if c not in key]
    held = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))
    return rows.groupBy(*key).agg(held.alias("rows")).select(*key, F.aggregate("rows", start, merge).alias(name))


#: States that one task merges for a key.
FAN = 64


def merge_fold(rows: DataFrame, key: list[str], state: str, start: Callable, add: Callable, merge: Callable, held: int = 100_000) -> DataFrame:
    """(key, ...) with the fields of a caller's state, a dict by a DDL string, folded over groups of any size in no order.

    add(state, row) and merge(state, state) give a state; a row is a dict of the columns that are
    no keys. Each task folds what it reads into one state a key, and hands its states on early when
    it holds so many keys; then at most FAN states of a key meet in a task, over as many
    levels as it takes. No task ever holds the rows of a group.
    """
    names = [c for c in rows.columns if c not in key]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in key)
    fields = [f.name for f in StructType.fromDDL(state)]
    shape = StructType.fromDDL(f"{kinds}, {state}")

    def out(states: dict) -> pa.RecordBatch:
        made = [dict(zip(key, k, strict=True)) | {f: s[f] for f in fields} for k, s in states.items()]
        return pa.RecordBatch.from_pylist(made, schema=to_arrow_schema(shape))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                k = tuple(r[c] for c in key)
                states[k] = add(states[k] if k in states else start(), {c: r[c] for c in names})
            if len(states) >= held:
                yield out(states)
                states = {}
        yield out(states)

    def together(table: pa.Table) -> pa.Table:
        (k,) = {tuple(r[c] for c in key) for r in table.select(key).slice(0, 1).to_pylist()}
        total = None
        for batch in table.to_batches(max_chunksize=1024):
            for r in batch.to_pylist():
                total = r if total is None else merge(total, r)
        return pa.Table.from_batches([out({k: total})])

    partial = materialize(rows.mapInArrow(first, shape), "states")
    while (most := partial.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > 1:
        part = F.floor(F.rand(most) * (-(-most // (FAN // 2)))) if most > FAN else F.lit(0)
        salted = materialize(partial.withColumn("textloom_part", part.cast("int")), "states")
        last, partial = partial, materialize(salted.groupBy(*key, "textloom_part").applyInArrow(together, shape), "states")
        discard(last)
        discard(salted)
    return partial
