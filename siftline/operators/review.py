"""Human review: flagging, queue table, decisions, confirmed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.draws import let
from siftline.schema import LABELS

# The confidence band sent to review, both ends included.
REVIEW_LOW = 0.4
REVIEW_HIGH = 0.6
REVIEWED_SOURCE = "human_reviewed"


def needs_human_review(confidence: Column | str) -> Column:
    column = F.col(confidence) if isinstance(confidence, str) else confidence
    # Bound once: a filter on this flag carries the whole scoring expression with it.
    return let(column, lambda c: c.between(REVIEW_LOW, REVIEW_HIGH))


def review_items(classified: DataFrame, *, created_at: Column | None = None) -> DataFrame:
    """Rows to append to the review table.

    The item id is a hash of message id and text, so replaying a batch yields the same
    items instead of new ones.
    """
    when = created_at if created_at is not None else F.current_timestamp()
    return classified.filter(needs_human_review("confidence")).select(
        F.sha2(F.concat_ws("|", F.col("message_id").cast("string"), "text"), 256).alias("item_id"),
        "message_id", "text", "cleaned_text", "label", "confidence", "probabilities",
        when.alias("created_at"),
    )


def pending(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items without a decision."""
    return items.join(decisions.select("item_id").distinct(), "item_id", "left_anti")


def list_pending(items: DataFrame, decisions: DataFrame, *, limit: int = 50) -> DataFrame:
    """The oldest pending items, ties by item id."""
    return pending(items, decisions).orderBy("created_at", "item_id").limit(limit)


def decision_problem(labels: Sequence[str] = LABELS) -> Column:
    """Why a decision row is unusable, or null."""
    corrected = F.col("corrected_label")
    return F.when(~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)), "unknown decision").when(
        corrected.isNotNull() & (corrected != "") & ~corrected.isin(*labels), "unknown label"
    )


def resolve(items: DataFrame, decisions: DataFrame, *, labels: Sequence[str] = LABELS) -> tuple[DataFrame, DataFrame]:
    """Apply decisions (item_id, decision, corrected_label, decided_at).

    The first valid decision on an item wins. Returns (resolved, errors): resolved items
    with the final label and whether they join the training data; decision rows that are
    invalid or name an unknown item, with the reason.
    """
    tagged = decisions.withColumn("reason", decision_problem(labels))
    first = (
        tagged.filter(F.col("reason").isNull())
        .groupBy("item_id")
        .agg(F.min(F.struct("decided_at", "decision", "corrected_label")).alias("d"))
        .select("item_id", "d.*")
    )
    final = F.coalesce(F.nullif(F.col("corrected_label"), F.lit("")), F.col("label"))
    resolved = items.join(first, "item_id").select(
        "item_id", "message_id", "text", "decision", "decided_at",
        F.when(F.col("decision") == "approve", final).alias("final_label"),
        (F.col("decision") == "approve").alias("appended"),
    )
    unknown = (
        tagged.filter(F.col("reason").isNull())
        .join(items.select("item_id"), "item_id", "left_anti")
        .withColumn("reason", F.lit("unknown item"))
    )
    errors = tagged.filter(F.col("reason").isNotNull()).unionByName(unknown)
    return resolved, errors


def confirmed_records(resolved: DataFrame, *, lang: str = "tr") -> DataFrame:
    """Approved messages in record form, ready to append."""
    return resolved.filter("appended").select(
        "text", F.col("final_label").alias("label"), F.lit(REVIEWED_SOURCE).alias("source"), F.lit(lang).alias("lang")
    )
