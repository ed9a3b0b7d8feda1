"""Splits, classifier training and test evaluation."""

from __future__ import annotations

import math
import warnings

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame, functions as F

from siftline.functions.urls import mark_all
from siftline.operators.evaluate import class_weights, macro_metrics
from siftline.operators.skew import draw_thresholds, hex_draw, lookup_join
from siftline.schema import MODEL_LABELS, label_index
from siftline.session import materialize

#: MB of rows that a step of the fit multiplies at once. Every such block, at Spark's default of 1 MB some hundred texts, costs a
#: pass over an array of all features times all labels, and that array also leaves every task.
BLOCK_MB = 16.0
#: Tasks of the fit per core of the cluster.
TASKS = 2


def _can_stratify(labels: int, smallest: int | None, rows: int | None, val_size: float, test_size: float) -> bool:
    if not labels or smallest < 3:
        return False
    return min(math.floor(rows * share + 0.5) for share in (val_size, test_size)) >= labels


def split_dataset(
    df: DataFrame,
    *,
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = 42,
    label_col: str = "label",
    key_cols: tuple[str, ...] = ("text", "lang"),
    group_col: str | None = None,
) -> DataFrame:
    """Add ``split`` (train, val, test), stratified by label, exact in every stratum.

    Rows are drawn by a hash of the seed and their key, so the split is repeatable and
    independent of partitioning. The bounds of the draws are found by counting, see
    :func:`draw_thresholds`: no row is sorted and no text is shuffled. Rows with equal keys stay together. With ``group_col`` all rows of a group land in one
    split, which keeps variants of one seed text from leaking into the test set. Falls
    back to an unstratified split, with a warning, when a class is too small.
    """
    if group_col is not None:
        groups = materialize(
            df.groupBy(group_col).agg(F.min(label_col).alias(label_col), F.count(F.lit(1)).alias("_n"))
        )
        assigned = materialize(
            split_dataset(
                groups, val_size=val_size, test_size=test_size, seed=seed, label_col=label_col, key_cols=(group_col,)
            ).select(group_col, "split", "_n")
        )
        return lookup_join(df, assigned, [group_col], weight="_n", how="inner").select(*df.columns, "split")

    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    strata = sizes.agg(F.count(F.lit(1)).alias("labels"), F.min("n").alias("smallest"), F.sum("n").alias("rows")).first()
    by: list[str] = [label_col]
    if not _can_stratify(strata["labels"], strata["smallest"], strata["rows"], val_size, test_size):
        warnings.warn("stratified split failed (a class is too small); falling back to a non-stratified split")
        by = []
    group = F.col(label_col) if by else F.lit(0)
    draw = hex_draw(seed, *key_cols)
    counts = {r["g"]: r["n"] for r in df.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per label
    test = {g: math.floor(n * test_size + 0.5) for g, n in counts.items()}
    val = {g: test[g] + math.floor(n * val_size + 0.5) for g, n in counts.items()}
    slim = materialize(df.select(group.alias("_group"), draw.alias("_draw")))
    bounds = draw_thresholds(slim, sorted({(g, k) for part in (test, val) for g, k in part.items()}, key=repr))
    kind = slim.schema["_group"].dataType.simpleString()
    limits = df.sparkSession.createDataFrame([(g, bounds[g, test[g]], bounds[g, val[g]]) for g in counts], f"_group {kind}, _test string, _val string")
    drawn = df.withColumn("_draw", draw).join(F.broadcast(limits), F.col("_group").eqNullSafe(group), "left")
    part = F.when(F.col("_draw") <= F.col("_test"), "test").when(F.col("_draw") <= F.col("_val"), "val").otherwise("train")
    return drawn.withColumn("split", part).select(*df.columns, "split")


def split_counts(split: DataFrame, *, label_col: str = "label") -> DataFrame:
    return split.groupBy("split", label_col).agg(F.count(F.lit(1)).alias("records"))


def training_text(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Model input: the markers are added here and at scoring time, never stored."""
    return df.withColumn("model_text", mark_all(text_col))


def _stages(num_features: int, max_iter: int, reg: float) -> list:
    return [
        RegexTokenizer(inputCol="model_text", outputCol="_words", pattern=r"\s+", minTokenLength=1),
        NGram(n=2, inputCol="_words", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(_words, _bigrams) AS _tokens FROM __THIS__"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(
            featuresCol="features", labelCol="label_id", weightCol="weight", maxIter=max_iter, regParam=reg,
            family="multinomial", predictionCol="prediction_id", maxBlockSizeInMB=BLOCK_MB,
        ),
    ]


def _named(scored: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(x) for x in MODEL_LABELS])
    return scored.withColumn("prediction", F.get(names, F.col("prediction_id").cast("int")))


def _predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    return _named(model.transform(df if "model_text" in df.columns else training_text(df)))


def train_classifier(
    train: DataFrame,
    val: DataFrame,
    *,
    focal_gamma: float = 2.0,
    num_features: int = 1 << 18,
    max_iter: int = 50,
    reg: float = 1e-4,
) -> tuple[PipelineModel, DataFrame]:
    """Three-class text classifier with class weights and one focal re-weighting round.

    The first model uses inverse-frequency weights; the second multiplies them by
    (1 - p)^gamma of the first model, so easy rows count less. The better one by macro-F1
    on ``val`` is returned together with the two validation scores. Transformed columns
    keep prefix ``_`` and are dropped by the scorer.
    """
    from pyspark.ml.functions import vector_to_array

    *hashing, idf, regression = _stages(num_features, max_iter, reg)
    hashing = PipelineModel(hashing)
    weights = class_weights(train).select("label", "weight")  # one row per label
    # Every fit and every candidate reads the counted words, so texts are cut into words once.
    weighted = training_text(train).withColumn("label_id", label_index("label").cast("double")).join(F.broadcast(weights), "label")
    counted = materialize(hashing.transform(weighted).select("label_id", "weight", "_tf"))
    # So many tasks as the cluster has use for, whatever the input: each sends its gradient, as long as the model, in every iteration.
    counted = counted.coalesce(TASKS * train.sparkSession.sparkContext.defaultParallelism)
    val = materialize(hashing.transform(training_text(val)).select("label", "_tf"))
    scale = idf.fit(counted)
    base = scale.transform(counted).select("features", "label_id", "weight")
    first = regression.fit(base)
    candidates = [("class_weights", first)]
    if focal_gamma > 0:
        p_true = F.get(vector_to_array("probability"), F.col("label_id").cast("int"))
        hard = first.transform(base).withColumn(
            "weight", F.col("weight") * F.pow(F.lit(1.0) - p_true, F.lit(focal_gamma)) + F.lit(1e-6)
        )
        candidates.append(("focal", regression.fit(hard.select("features", "label_id", "weight"))))
    scored = []
    for name, model in candidates:
        row = macro_metrics(_named(PipelineModel([scale, model]).transform(val))).first()
        scored.append((name, float(row["f1_macro"] or 0.0)))
    best = max(range(len(candidates)), key=lambda i: scored[i][1])
    report = train.sparkSession.createDataFrame(scored, "candidate string, val_f1_macro double")
    return PipelineModel([*hashing.stages, scale, candidates[best][1]]), report


def evaluate_model(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Accuracy and macro precision, recall, F1 on a test split."""
    return macro_metrics(_predictions(model, test))
