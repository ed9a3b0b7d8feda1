"""Monitoring numbers over scored messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds of the confidence histogram.
BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def messages_by_label(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("messages"))


def _histogram_columns(buckets: Sequence[float]) -> list[Column]:
    counts = [F.count_if(F.col("confidence") <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    return [*counts, F.count("confidence").alias("observations"), F.sum("confidence").alias("total_confidence")]


def confidence_histogram(scored: DataFrame, *, buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative buckets in one pass: le (text, '+Inf' last), messages, and the overall sum."""
    totals = scored.agg(*_histogram_columns(buckets))
    entries = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("messages")) for i, b in enumerate(buckets)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("messages")))
    return totals.select(F.explode(F.array(*entries)).alias("b"), "total_confidence").select(
        "b.le", "b.messages", "total_confidence"
    )


def counters(scored: DataFrame) -> DataFrame:
    """Total messages, messages sent to review, outbreak alerts."""
    return scored.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if("needs_review").alias("review_queue"),
        F.count_if("is_outbreak_candidate").alias("outbreak_alerts"),
    )


def windowed_metrics(scored: DataFrame, *, width: str = "1 hour", ts_col: str = "ts") -> DataFrame:
    """Per time window and label: messages, reviews, alerts, mean confidence.

    Works on batch and streaming input; a stream sets its watermark first.
    """
    return (
        scored.groupBy(F.window(ts_col, width).alias("w"), "label")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.count_if("needs_review").alias("review_queue"),
            F.count_if("is_outbreak_candidate").alias("outbreak_alerts"),
            F.avg("confidence").alias("mean_confidence"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "messages", "review_queue", "outbreak_alerts", "mean_confidence")
    )
