"""Shared files and dense numbering."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only in local mode, where one machine has all files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where written tables lie, for as long as their DataFrames are held.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    _PATHS[held] = path
    return held


def discard(df: DataFrame | None) -> None:
    """Remove the files of a table from ``materialize`` that nothing reads any more, such as the last round's of a loop."""
    path = _PATHS.pop(df, None) if df is not None else None
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the files of exchanges that nothing reads any more go before the next step writes its own; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df written by ranges of the order, with textloom_part, the number of the range."""
    return materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("textloom_part", F.spark_partition_id()), "ranges")


def _begins(held: DataFrame, size: Column) -> DataFrame:
    """(textloom_part, textloom_begin): what the ranges before each one amount to; as many rows as there are ranges."""
    starts, at = [], 0
    for part, n in sorted((r[0], r[1]) for r in held.groupBy("textloom_part").agg(size).collect()):
        starts.append((part, at))
        at += n
    return held.sparkSession.createDataFrame(starts, "textloom_part int, textloom_begin long")


def running_starts(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """df with the sum of a whole-number weight over all rows before each one in an order that tells all rows apart; no task sorts the whole table."""
    held = _ranges(df, order)
    before = Window.partitionBy("textloom_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumn("textloom_before", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    out = out.join(F.broadcast(_begins(held, F.sum(weight))), "textloom_part")
    return out.withColumn(name, F.col("textloom_begin") + F.col("textloom_before")).select(*df.columns, name)


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """df with gapless numbers from 0 in the order of columns whose values tell all rows apart.

    Rows are range-partitioned and numbered part by part; the parts' starts are a list
    as long as the number of partitions, so no task sorts the whole table.
    """
    held = _ranges(df, order)
    rank = F.row_number().over(Window.partitionBy("textloom_part").orderBy(*order))
    out = held.withColumn("textloom_rank", rank).join(F.broadcast(_begins(held, F.count("*"))), "textloom_part")
    return out.withColumn(name, F.col("textloom_begin") + F.col("textloom_rank") - 1).select(*df.columns, name)
