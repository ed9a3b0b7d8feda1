"""Structured Streaming jobs: classification with outbreak detection, and live metrics.

Outbreak state is a stored index (:mod:`siftline.operators.outbreak_index`) that every
micro-batch extends by one part. A micro-batch is detected with the batch operators against the index, so a burst of
identical messages is combined before any shuffle, AQE applies, and a replayed batch
is neither matched with itself nor added twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.functions.hashing import simhash
from siftline.operators.metrics import windowed_metrics
from siftline.operators.outbreak_index import IndexOptions, OutbreakIndex
from siftline.operators.review import review_items
from siftline.plans.classify import Scorer, classify, latest_messages
from siftline.session import ensure_checkpoint_dir, materialize

BATCH = "batch_id"


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, readable by every executor."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/siftline-{uuid.uuid4().hex}"


def finish(query: StreamingQuery, *, seconds: int | None = None) -> None:
    """Wait for a stream that processes what is available, and stop it in any case.

    It is given as long as it takes unless the caller sets a limit.
    """
    try:
        if query.awaitTermination(seconds) is False:
            raise TimeoutError(f"stream still active after {seconds} seconds")
    finally:
        query.stop()


#: Writer of stream parts in an index's manifest.
STREAM = "stream"


def detect_batch(
    fps: DataFrame,
    batch_id: int,
    index_path: str,
    *,
    ttl_seconds: int,
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    late_after_seconds: int | None = None,
    shards: int = 64,
    fan_in: int = 8,
) -> DataFrame:
    """Outbreak verdicts for one micro-batch, which then becomes part of the index.

    ``fps`` is materialised (message_id, ts, fp). Rows older than the newest indexed
    message by more than ``late_after_seconds`` are judged but not remembered; with that
    bound, time buckets that no row can match any more are deleted.
    """
    spark = fps.sparkSession
    options = IndexOptions(ttl_seconds, threshold, num_bands, hash_bits, shards, fan_in)
    index = OutbreakIndex(spark, index_path, options, id_type=fps.schema["message_id"].dataType.simpleString())
    verdicts = materialize(index.verdicts(fps, before_batch=batch_id, writer=STREAM))
    newest = index.newest(index.parts(before_batch=batch_id, writer=STREAM))
    fresh = fps
    if late_after_seconds is not None and newest is not None:
        fresh = fps.filter(F.unix_micros("ts") >= int((newest - late_after_seconds) * 1_000_000))
    index.add(fresh, batch=batch_id, writer=STREAM)
    if late_after_seconds is not None and newest is not None:
        index.expire(newest - late_after_seconds - ttl_seconds)
    index.compact(keep_batch=batch_id)
    return verdicts


def start_outbreak_stream(
    messages: DataFrame,
    out_dir: str,
    checkpoint: str,
    *,
    ttl_seconds: int,
    id_col: str = "message_id",
    text_col: str = "text",
    ts_col: str = "ts",
    hash_fn: str = "blake2b",
    available_now: bool = True,
    **detection,
) -> StreamingQuery:
    """Verdict rows under ``out_dir/verdicts``, state under ``out_dir/index``."""
    from siftline.operators.outbreak import fingerprint_messages

    def run(batch: DataFrame, batch_id: int) -> None:
        fps = materialize(
            fingerprint_messages(batch, id_col=id_col, text_col=text_col, ts_col=ts_col, hash_fn=hash_fn)
        )
        verdicts = detect_batch(fps, batch_id, f"{out_dir}/index", ttl_seconds=ttl_seconds, **detection)
        verdicts.write.mode("overwrite").parquet(f"{out_dir}/verdicts/{BATCH}={batch_id}")

    return _start(messages, run, checkpoint, available_now)


def start_classification_stream(
    messages: DataFrame,
    scorer: Scorer,
    out_dir: str,
    checkpoint: str,
    *,
    ttl_seconds: int,
    hash_fn: str = "blake2b",
    normalize: str = "full",
    available_now: bool = True,
    **detection,
) -> StreamingQuery:
    """Classify a stream (message_id, text, ts) with outbreak detection.

    Writes ``out_dir/results`` and ``out_dir/review_items`` per micro-batch; the outbreak
    index lives in ``out_dir/index``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        scored = materialize(
            classify(latest_messages(batch), scorer, normalize=normalize).withColumn("fp", simhash("cleaned_text", hash_fn=hash_fn))
        )
        fps = scored.select("message_id", F.col("ts").cast("timestamp").alias("ts"), "fp")
        verdicts = detect_batch(fps, batch_id, f"{out_dir}/index", ttl_seconds=ttl_seconds, **detection)
        results = scored.drop("fp").join(verdicts.drop("ts"), "message_id", "left")
        results.write.mode("overwrite").parquet(f"{out_dir}/results/{BATCH}={batch_id}")
        items = review_items(scored, created_at=F.col("ts").cast("timestamp"))
        items.write.mode("overwrite").parquet(f"{out_dir}/review_items/{BATCH}={batch_id}")

    return _start(messages, run, checkpoint, available_now)


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/results")


def read_review_items(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/review_items").drop(BATCH)


def start_metrics_stream(
    scored: DataFrame,
    out_path: str,
    checkpoint: str,
    *,
    width: str = "1 hour",
    watermark: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Windowed counters and mean confidence.

    With a ``watermark`` closed windows are appended, one folder per micro-batch, and
    their state is dropped. Without one the whole table is rewritten each time, which is
    meant for bounded replays.
    """
    # Rows without a label only move the watermark on.
    source = scored.observe(ARRIVED, F.count("label").alias("rows"), F.max("ts").alias("newest"))
    source = source.withWatermark("ts", watermark) if watermark else source
    table = windowed_metrics(source, width=width)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/{BATCH}={batch_id}")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    if watermark:
        return _start(table, append, checkpoint, available_now, mode="append")
    return _start(table, replace, checkpoint, available_now, mode="complete")


ARRIVED = "arrived"


def late_rows(query: StreamingQuery, closed: DataFrame) -> int:
    """Rows that came after their window had been closed, of a metrics stream that has ended with all windows closed.

    They are what was observed on arrival less what the ``closed`` windows count. The query's progress
    reports must reach back to its first batch (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    reports = query.recentProgress
    if reports and reports[0]["batchId"] > 0:
        raise ValueError("progress reports do not reach back to the first batch")
    seen = sum(r["observedMetrics"][ARRIVED]["rows"] for r in reports if r["observedMetrics"] and r["observedMetrics"].get(ARRIVED))
    return seen - (closed.agg(F.sum("messages")).first()[0] or 0)


def _start(
    df: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, *, mode: str = "append"
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
