"""A vocabulary that grows with a stream: every new word gets the next number, once and for good."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.tables import dense_ids

SHAPE = "word string, id long, batch long"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, id, batch) as far as the stream has come."""
    try:
        return spark.read.schema(SHAPE).parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SHAPE)


def find_or_add(path: str, column: str = "word") -> Callable[[DataFrame, int], None]:
    """What to give to writeStream.foreachBatch: each batch's new words get gapless numbers behind those of the batches before.

    A batch writes one folder of its own, over whatever an earlier try has left there, and looks
    only at the batches before it. So a batch that is run again after a failure gives the same
    words the same numbers. Words meet the vocabulary in one anti join; numbers come from ranges.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = read_vocabulary(spark, path).filter(F.col("batch") < number)
        words = batch.select(F.col(column).cast("string").alias("word")).filter("word IS NOT NULL").distinct()
        new = dense_ids(words.join(known.select("word"), "word", "left_anti"), ["word"])
        new = new.select("word", (F.col("id") + known.count()).alias("id"))
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def follow(words: DataFrame, path: str, checkpoint: str, column: str = "word"):
    """The running query of a stream of words that keeps the vocabulary under path; it takes what there is and ends."""
    return words.writeStream.foreachBatch(find_or_add(path, column)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
