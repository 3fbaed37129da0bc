"""Detection and resumable verification over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphwell.functions import text as X


def legacy_words(stream: DataFrame, text: str = "text", reach: int = 6) -> DataFrame:
    """``stream`` with ``words`` and ``dense_words``: how many are legacy by density, or near one within ``reach``.

    The context of a word is inside its document, so this is stateless: an array
    expression in place of the window of the batch operator.
    """
    words = X.words(text)
    sure = F.transform(words, lambda w: (X.count_of(w, X.BIJOY) * 10 >= F.length(w)) & X.two_distinct(w, X.BIJOY))
    some = F.transform(words, lambda w: w.rlike(f"[{X.BIJOY}]"))
    near = F.transform(sure, lambda x, i: F.exists(F.slice("_sure", F.greatest(i - reach + 1, F.lit(1)), F.least(i + reach + 1, F.size("_sure")) - F.greatest(i - reach + 1, F.lit(1)) + 1), lambda y: y))
    out = stream.withColumn("_sure", sure).withColumn("_near", near).withColumn("_some", some)
    judged = F.zip_with("_near", "_some", lambda a, b: a & b)
    return out.withColumn("words", F.size("_sure")).withColumn("dense_words", F.size(F.filter(judged, lambda y: y))).drop("_sure", "_near", "_some")


def once_by_hash(stream: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Each content hash once, with state kept for ``delay`` of event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["in_hash"])


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tallies by kind of event in tumbling windows, late rows within ``delay`` counted."""
    windows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
