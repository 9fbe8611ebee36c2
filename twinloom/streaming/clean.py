"""Extension: corpus cleaning as a stream (the batch rules as a stateless stage, then bounded-state deduplication)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions import text as T
from twinloom.operators import corpus, filters


def accepted_stream(pairs: DataFrame, event_time: str, lateness: str = "1 day") -> DataFrame:
    """Accepted pairs, each once within the lateness. State is bounded by the watermark."""
    clean = corpus.clean_pairs(pairs, full=True).withColumn("reason", filters.pair_reason(F.col("zh"), F.col("en")))
    keyed = clean.where("reason IS NULL").withColumn("pair_key", T.pair_key(F.col("zh"), F.col("en")))
    return keyed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["pair_key"]).drop("reason")


def windowed_reasons(pairs: DataFrame, event_time: str, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Reasons per tumbling window; works on streams and on tables."""
    judged = corpus.clean_pairs(pairs, full=True).withColumn("reason", F.coalesce(filters.pair_reason(F.col("zh"), F.col("en")), F.lit("accepted")))
    return judged.withWatermark(event_time, lateness).groupBy(F.window(event_time, window).alias("w"), "reason").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "reason", "n")
