"""Evaluation: confusion, macro metrics, class weights, focal loss, regression report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.draws import let
from siftline.schema import MODEL_LABELS


def confusion(df: DataFrame, *, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """Row counts per (truth, predicted); the only pass over the data."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("records")
    )


def per_label_metrics(confused: DataFrame) -> DataFrame:
    """precision, recall, f1 per label seen in truth or prediction; 0 where undefined."""
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")),
        F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")),
    )
    rows = confused.select(
        F.explode(sides).alias("s"), "records", (F.col("truth") == F.col("predicted")).alias("hit")
    )
    is_truth = F.col("s.side") == "t"
    totals = rows.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(is_truth & F.col("hit"), F.col("records")).otherwise(0)).alias("tp"),
        F.sum(F.when(is_truth, F.col("records")).otherwise(0)).alias("support"),
        F.sum(F.when(~is_truth, F.col("records")).otherwise(0)).alias("predicted"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return totals.select(
        "label", "support", "predicted", "tp",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def macro_metrics(df: DataFrame, *, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: accuracy, precision_macro, recall_macro, f1_macro."""
    return per_label_metrics(confusion(df, truth=truth, predicted=predicted)).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def class_weights(df: DataFrame, *, label: str = "label", labels: Sequence[str] = MODEL_LABELS) -> DataFrame:
    """label, records, weight = N / (number of labels * max(count, 1)); absent labels included."""
    counts = [F.count_if(F.col(label) == name).alias(f"c{i}") for i, name in enumerate(labels)]
    totals = df.filter(F.col(label).isin(*labels)).agg(F.count(F.lit(1)).alias("n"), *counts)
    entries = F.array(
        *[F.struct(F.lit(name).alias("label"), F.col(f"c{i}").alias("records")) for i, name in enumerate(labels)]
    )
    return totals.select("n", F.explode(entries).alias("e")).select(
        "e.label", "e.records",
        (F.col("n") / (F.lit(len(labels)) * F.greatest(F.col("e.records"), F.lit(1)))).alias("weight"),
    )


def focal_loss(
    probability: Column | str, *, alpha: Column | float | None = None, gamma: float = 2.0
) -> Column:
    """Per-row focal loss from the probability of the true label; gamma 0 is cross-entropy."""
    p = F.col(probability) if isinstance(probability, str) else probability
    loss = -F.pow(F.lit(1.0) - p, F.lit(gamma)) * F.ln(p)
    if alpha is None:
        return loss
    return (alpha if isinstance(alpha, Column) else F.lit(alpha)) * loss


def focal_loss_summary(df: DataFrame, loss: Column, *, reduction: str = "mean") -> DataFrame:
    """Plain mean or sum over rows, or one loss per row."""
    if reduction == "mean":
        return df.agg(F.avg(loss).alias("loss"))
    if reduction == "sum":
        return df.agg(F.sum(loss).alias("loss"))
    if reduction == "none":
        return df.withColumn("loss", loss)
    raise ValueError("reduction must be mean, sum or none")


def best_label(probabilities: Column | str, labels: Sequence[str] = MODEL_LABELS) -> Column:
    """STRUCT<p, order, label> of the most probable label; ties go to the lowest label id."""
    column = F.col(probabilities) if isinstance(probabilities, str) else probabilities

    def choose(p: Column) -> Column:
        options = F.array(
            *[
                F.struct(F.try_element_at(p, F.lit(name)).alias("p"), F.lit(-i).alias("order"), F.lit(name).alias("label"))
                for i, name in enumerate(labels)
            ]
        )
        return F.when(p.isNotNull(), F.array_max(options))

    return let(column, choose)


def regression_cases(predictions: DataFrame) -> DataFrame:
    """Expected against predicted per case: adds ``ok``."""
    return predictions.withColumn("ok", F.col("expected") == F.col("label"))


def regression_summary(cases: DataFrame) -> DataFrame:
    """cases, passed, failed, and whether the suite passed."""
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed")
    ).withColumn("suite_passed", F.col("failed") == 0)


def regression_failures(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("ok"))
