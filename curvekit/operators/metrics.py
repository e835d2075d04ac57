"""Evaluation metrics over prediction tables and parameter counts over inventories.

Classification metrics are functions of four confusion counts, so only counts are
shuffled: one row per group and map task.
"""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvekit import fixed_values as fv
from curvekit.operators.config import lookup


def argmax(values: str) -> Column:
    """Position (from 0) of the largest value, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confusion(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of a two-class confusion table, all rows and right ones, per group."""
    pred, label = F.col("pred"), F.col("label")
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pred == label).alias("n_right"),
        F.count_if((pred == 1) & (label == 1)).alias("tp"),
        F.count_if((pred == 1) & (label != 1)).alias("fp"),
        F.count_if((pred != 1) & (label == 1)).alias("fn"),
        F.count_if((pred != 1) & (label != 1)).alias("tn"),
    )


ACCURACY = "double(n_right) / n"
F1 = "coalesce(try_divide(2D * tp, 2D * tp + fp + fn), 0D)"
MATTHEWS = (
    "coalesce(try_divide(double(tp) * tn - double(fp) * fn, "
    "sqrt((double(tp) + fp) * (double(tp) + fn) * (double(tn) + fp) * (double(tn) + fn))), 0D)"
)


def accuracy(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of predictions equal to the label, any number of classes; a null prediction is wrong."""
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col("pred") == F.col("label"), F.lit(False)).cast("double")).alias("accuracy"),
    )


def f1_score(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F1 of class 1; zero when there is neither a positive label nor a positive prediction."""
    return confusion(predictions, keys).select(*keys, F.expr(F1).alias("f1"))


def matthews_correlation(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matthews correlation of two classes; zero when a row or column of the table is empty."""
    return confusion(predictions, keys).select(
        *keys, F.expr(MATTHEWS).alias("matthews_correlation")
    )


def task_metrics(
    predictions: DataFrame, keys: Sequence[str] = ("run_id",), task: str = "task"
) -> DataFrame:
    """Metrics of the row's task in one pass: accuracy always, F1 and MCC where they apply.

    The primary metric appears under `primary_metric`, `eval_primary_metric` and the
    `eval_` column of its own name. A task that is not known has accuracy, but no primary metric,
    and `status` says so; null predictions count as wrong.
    """
    named = {t: metric for t, (_, _, metric) in fv.TASK_FACTS.items()}
    metrics = ("accuracy", "f1", "matthews_correlation")
    return (
        confusion(predictions, [*keys, task])
        .withColumn("primary_metric_name", lookup(named, F.col(task)))
        .withColumns(
            {
                "accuracy": F.expr(ACCURACY),
                "f1": F.when(F.col("primary_metric_name") == "f1", F.expr(F1)),
                "matthews_correlation": F.when(
                    F.col("primary_metric_name") == "matthews_correlation", F.expr(MATTHEWS)
                ),
            }
        )
        .withColumn(
            "primary_metric",
            F.when(
                F.col("primary_metric_name").isNotNull(),
                F.coalesce("f1", "matthews_correlation", "accuracy"),
            ),
        )
        .withColumn("status", F.when(F.col("primary_metric_name").isNull(), "unknown_task").otherwise("ok"))
        .select(
            *keys,
            task,
            "n",
            *metrics,
            "primary_metric_name",
            "primary_metric",
            "status",
            F.col("primary_metric").alias("eval_primary_metric"),
            *[
                F.when(F.col("primary_metric_name") == m, F.col("primary_metric")).alias(f"eval_{m}")
                for m in metrics
            ],
        )
    )


def generated_score(generations: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Generated answers that contain the expected word, ignoring case.

    Containment is by substring: "no" is found in "know". Null texts count as wrong.
    """
    right = F.contains(F.lower(F.trim("generated")), F.lower("expected"))
    counts = [F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total")]
    grouped = generations.groupBy(*keys).agg(*counts) if keys else generations.agg(*counts)
    return grouped.withColumn(
        "accuracy", F.expr("coalesce(try_divide(double(correct), total), 0D)")
    )


def _named_like(parts: Sequence[str]) -> Column:
    return reduce(or_, [F.contains("name", F.lit(part)) for part in parts])


def trainable_mask(method: str, architecture: str = "encoder") -> Column:
    """Whether a parameter is trained: all for full fine-tuning, chosen by name for bias-only.

    Encoders train names that end in "bias" and the classifier; decoders any name with "bias".
    Adapter methods train what the inventory marks as theirs (`requires_grad`).
    """
    if method == "full_ft":
        return F.lit(True)
    if method == "bitfit":
        if architecture == "decoder":
            return _named_like(["bias"])
        return F.endswith("name", F.lit("bias")) | _named_like(fv.CLASSIFIER_NAME_PARTS)
    return F.coalesce(F.col("requires_grad"), F.lit(False))


def count_parameters(
    inventory: DataFrame,
    keys: Sequence[str] = ("model",),
    denominator: str = "wrapped",
) -> DataFrame:
    """Total and trainable parameter numbers and their percentage.

    `denominator` says what the total covers: 'wrapped' counts all rows, 'base' leaves out
    those that an adapter added (`is_adapter`).
    """
    if denominator not in ("wrapped", "base"):
        raise ValueError(f"unknown denominator: {denominator}")
    base = F.when(~F.col("is_adapter"), F.col("numel"))
    total = F.col("numel") if denominator == "wrapped" else base
    return (
        inventory.groupBy(*keys)
        .agg(
            F.sum(total).alias("total_parameters"),
            F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).alias(
                "trainable_parameters"
            ),
        )
        .withColumn(
            "trainable_percentage",
            F.try_divide(F.lit(100.0) * F.col("trainable_parameters"), F.col("total_parameters")),
        )
    )
