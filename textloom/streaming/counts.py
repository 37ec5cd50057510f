"""Word and event counts over streams, in event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import tokenize


def word_counts(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "ts", text: str = "text") -> DataFrame:
    """(start, end, word, n) for each window; rows later than the watermark are left out once it has passed."""
    words = stream.withWatermark(time, late).select(time, F.explode(tokenize.whitespace(F.col(text))).alias("word"))
    counted = words.groupBy(F.window(time, window).alias("w"), "word").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "word", "n")


def event_counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) of an events table or stream; a slide makes the windows overlap."""
    held = stream.withWatermark("ts", late) if stream.isStreaming else stream
    counted = held.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events without a pause longer than the gap."""
    held = stream.withWatermark("ts", late) if stream.isStreaming else stream
    counted = held.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
