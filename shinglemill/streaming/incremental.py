"""Incremental removal of exact duplicates on a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglemill.operators.corpus import blank_normalised


def first_seen(stream: DataFrame, ts: str = "ts", text: str = "text", within: str = "1 hour") -> DataFrame:
    """The first document of each text up to white space among those no more than ``within`` apart. State is kept by hash and dropped
    when the watermark has passed, so it doesn't grow with the stream."""
    keyed = stream.withColumn("text_sha256", F.sha2(blank_normalised(F.coalesce(F.col(text), F.lit(""))), 256))
    return keyed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["text_sha256"])


def removed_per_window(stream: DataFrame, ts: str = "ts", text: str = "text", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``(start, documents, distinct_texts)`` by tumbling window; distinct texts are estimated in bounded state."""
    keyed = stream.withColumn("h", F.xxhash64(blank_normalised(F.coalesce(F.col(text), F.lit("")))))
    counted = keyed.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("documents"), F.approx_count_distinct("h").alias("distinct_texts"))
    return counted.select(F.col("window.start").alias("start"), "documents", "distinct_texts")
