"""Message classification: cleaning, one-time-password rule, scorer, review flag, outbreaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftline.functions.confusables import is_homoglyph_attack, strip_confusables
from siftline.functions.draws import let
from siftline.functions.rules import detect_otp
from siftline.functions.urls import extract_urls, mark_all
from siftline.functions.zero_width import strip_zero_width
from siftline.operators.evaluate import best_label
from siftline.operators.outbreak import flag_crowds, flag_fingerprints
from siftline.functions.hashing import simhash
from siftline.operators.review import needs_human_review
from siftline.schema import MODEL_LABELS, OTP
from siftline.session import materialize

# Fixed value: confidence reported for a rule match.
OTP_CONFIDENCE = 0.95

# A scorer adds ``probabilities`` MAP<STRING, DOUBLE> from column ``model_text``; rows
# settled by the rule have a null model_text.
Scorer = Callable[[DataFrame], DataFrame]


def column_scorer(make: Callable[[Column], Sequence[Column]], labels: Sequence[str] = MODEL_LABELS) -> Scorer:
    """Scorer from Column expressions: one probability per label."""

    def score(df: DataFrame) -> DataFrame:
        def row(text: Column) -> Column:
            pairs = [c for name, p in zip(labels, make(text)) for c in (F.lit(name), p)]
            return F.when(text.isNotNull(), F.create_map(*pairs))

        return df.withColumn("probabilities", let(F.col("model_text"), row))

    return score


def ml_scorer(model: PipelineModel, labels: Sequence[str] = MODEL_LABELS) -> Scorer:
    """Scorer from a trained pipeline; stays inside the JVM."""
    from pyspark.ml.functions import vector_to_array

    def score(df: DataFrame) -> DataFrame:
        kept = df.columns
        masked = df.withColumn("_is_rule", F.col("model_text").isNull()).withColumn(
            "model_text", F.coalesce("model_text", F.lit(""))
        )
        out = model.transform(masked).withColumn("_p", vector_to_array("probability"))
        pairs = [c for i, name in enumerate(labels) for c in (F.lit(name), F.get("_p", F.lit(i)))]
        return out.withColumn("probabilities", F.when(~F.col("_is_rule"), F.create_map(*pairs))).select(
            *kept, "probabilities"
        )

    return score


def batch_scorer(
    load_model: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
    labels: Sequence[str] = MODEL_LABELS,
) -> Scorer:
    """Scorer from any Python model: loaded once per task, called once per Arrow batch with
    the texts the rule has not settled."""

    def score(df: DataFrame) -> DataFrame:
        schema = T.StructType(
            [*df.schema.fields, T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))]
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load_model()
            for batch in batches:
                result = pd.Series([None] * len(batch), index=batch.index, dtype=object)
                todo = batch["model_text"].dropna()
                if len(todo):
                    for at, row in zip(todo.index, model(list(todo))):
                        result[at] = {name: float(p) for name, p in zip(labels, row)}
                yield batch.assign(probabilities=result)

        return df.mapInPandas(run, schema)

    return score


def classify(
    messages: DataFrame,
    scorer: Scorer,
    *,
    text_col: str = "text",
    labels: Sequence[str] = MODEL_LABELS,
    normalize: str = "full",
) -> DataFrame:
    """Stateless part of the flow; works on batch and streaming input.

    Adds cleaned_text, homoglyph_attack_detected, urls_found, label, confidence,
    probabilities, needs_review. A rule match gets label ``otp`` and never reaches the
    scorer.
    """
    visible = messages.withColumn("_visible", strip_zero_width(text_col)).withColumn(
        "homoglyph_attack_detected", is_homoglyph_attack("_visible")
    )
    cleaned = visible.withColumn("cleaned_text", strip_confusables("_visible", normalize=normalize)).drop("_visible")
    signalled = cleaned.withColumn("urls_found", extract_urls("cleaned_text")).withColumn(
        "_is_otp", detect_otp("cleaned_text")
    )
    prepared = signalled.withColumn("model_text", F.when(~F.col("_is_otp"), mark_all("cleaned_text", "urls_found")))
    scored = scorer(prepared).withColumn("_best", best_label("probabilities", labels))
    is_otp = F.col("_is_otp")
    confidence = F.when(is_otp, OTP_CONFIDENCE).otherwise(F.col("_best.p"))
    verdict = F.struct(
        F.when(is_otp, OTP).otherwise(F.col("_best.label")).alias("label"),
        confidence.alias("confidence"),
        F.when(is_otp, F.create_map(F.lit(OTP), F.lit(OTP_CONFIDENCE))).otherwise(F.col("probabilities")).alias("probabilities"),
        needs_human_review(confidence).alias("needs_review"),
    )
    # Emitted as a one-element array: a later filter on the verdict is then applied to the
    # finished columns, where a plain projection would have the optimizer copy the whole
    # scoring expression into the filter.
    kept = [c for c in scored.columns if c not in ("_is_otp", "_best", "model_text", "probabilities")]
    return scored.select(*kept, F.inline(F.array(verdict)))


def latest_messages(messages: DataFrame, *, id_col: str = "message_id", text_col: str = "text", ts_col: str = "ts") -> DataFrame:
    """One row per id, the latest; a missing id is derived from the text, so replays agree.

    Of rows with the same id and time the one whose text has the larger hash stays.
    """
    given = messages.schema[id_col].dataType
    fresh = F.sha2(text_col, 256) if isinstance(given, T.StringType) else F.xxhash64(text_col).cast(given)
    rows = messages.withColumn(id_col, F.coalesce(id_col, fresh))
    rest = [c for c in rows.columns if c != id_col]
    last = rows.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct(ts_col, F.xxhash64(text_col))).alias("_last"))
    return last.select(*[F.col(c) if c == id_col else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def classify_with_outbreaks(
    messages: DataFrame,
    scorer: Scorer,
    *,
    id_col: str = "message_id",
    text_col: str = "text",
    ts_col: str = "ts",
    threshold: float = 0.90,
    hash_fn: str = "blake2b",
    ttl_seconds: int | None = None,
    normalize: str = "full",
    flags_only: bool = False,
) -> DataFrame:
    """The whole flow in batch: :func:`classify` plus outbreak columns.

    A message sent again under its id takes the place of the earlier one, see
    :func:`latest_messages`. Only (id, ts, fingerprint) goes through outbreak detection; its
    verdicts join back on the id, which is then unique. With ``flags_only`` these are the fingerprint and the flag,
    for which no near pairs are listed (:func:`flag_crowds`).
    """
    messages = latest_messages(messages, id_col=id_col, text_col=text_col, ts_col=ts_col)
    cleaned = strip_confusables(strip_zero_width(text_col), normalize=normalize)
    fps = materialize(
        messages.select(
            F.col(id_col).alias("message_id"), F.col(ts_col).cast("timestamp").alias("ts"),
            simhash(cleaned, hash_fn=hash_fn).alias("fp"),
        )
    )
    if flags_only:
        flags = flag_crowds(fps, threshold=threshold, ttl_seconds=ttl_seconds)
        verdicts = flags.select("message_id", "fingerprint", "is_outbreak_candidate")
    else:
        verdicts = flag_fingerprints(fps, threshold=threshold, ttl_seconds=ttl_seconds).drop("ts")
    classified = classify(messages, scorer, text_col=text_col, normalize=normalize)
    return classified.withColumnRenamed(id_col, "message_id").join(verdicts, "message_id", "left")
