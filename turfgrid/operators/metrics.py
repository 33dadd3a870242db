"""Losses, loss history, and classification metrics from the confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfgrid.constants import FIRST_BEST_LOSS
from turfgrid.functions.cells import cross_entropy


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts by (y_true, y_pred); everything below works on this small table."""
    return predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def _ratio(part: Column, whole: Column) -> Column:
    """Share, 0 when there is nothing to share."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class seen in truth or prediction."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("y_true").alias("label"), hit.alias("hits"), F.col("n").alias("support"), F.lit(0).alias("named")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("hits"), F.lit(0).alias("support"), F.col("n").alias("named")),
    )
    sums = counts.select(F.inline(roles)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hits", "support", "named")])
    precision = _ratio(F.col("hits"), F.col("named"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.lit(2.0) * F.col("hits"), F.col("named") + F.col("support"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits")


def _macro(predictions: DataFrame, measure: str) -> DataFrame:
    return per_class(confusion(predictions)).agg(F.avg(measure).alias(f"macro_{measure}"))


def macro_precision(predictions: DataFrame) -> DataFrame:
    return _macro(predictions, "precision")


def macro_recall(predictions: DataFrame) -> DataFrame:
    return _macro(predictions, "recall")


def macro_f1(predictions: DataFrame) -> DataFrame:
    return _macro(predictions, "f1")


def _overall_accuracy() -> Column:
    return F.sum("hits") / F.sum("support")


def metrics(predictions: DataFrame) -> DataFrame:
    """The one-row evaluation table."""
    return per_class(confusion(predictions)).agg(
        _overall_accuracy().alias("accuracy"),
        *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """A row per class, then accuracy, macro and support-weighted averages.

    The few class rows are gathered beside their totals, so the predictions are read once.
    """
    classes = per_class(confusion(predictions))
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in ("precision", "recall", "f1")]
    macro = [F.avg(m).alias(f"m_{m}") for m in ("precision", "recall", "f1")]
    own = F.struct(F.col("label").cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("precision", "recall", "f1")], "support")
    totals = classes.agg(*macro, *weighted, _overall_accuracy().alias("acc"), F.sum("support").alias("support"), F.collect_list(own).alias("classes"))
    none = F.lit(None).cast("double")

    def line(name, precision, recall, f1):
        return F.struct(
            F.lit(name).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("support"),
        )

    lines = F.array(
        line("accuracy", none, none, F.col("acc")),
        line("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        line("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
    )
    return totals.select(F.inline(F.concat("classes", lines)))


def batch_bce(predictions: DataFrame, label: Column | None = None) -> DataFrame:
    """Mean binary cross-entropy of each batch, from `p` and `y_true` (or a given label)."""
    truth = F.col("y_true") if label is None else label
    return predictions.groupBy("batch_id").agg(F.avg(cross_entropy(truth, F.col("p"))).alias("loss"))


def selection_loss(predictions: DataFrame) -> DataFrame:
    """Batch loss where each pass did go to its destination: the label is 1 throughout."""
    return batch_bce(predictions, F.lit(1))


def epoch_loss(batch_losses: DataFrame) -> DataFrame:
    """Mean over the batch means, so a short last batch counts as much as a full one."""
    return batch_losses.agg(F.avg("loss").alias("loss"))


def checkpoints(history: DataFrame, run: str = "run") -> DataFrame:
    """Mark the epochs of each run whose validation loss is below every earlier one."""
    earlier = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.min("val_loss").over(earlier), F.lit(FIRST_BEST_LOSS))
    return history.withColumn("kept", F.col("val_loss") < F.least(best, F.lit(FIRST_BEST_LOSS)))


def best_epoch(history: DataFrame, run: str = "run") -> DataFrame:
    """The epoch each run ends up keeping: the earliest with the lowest validation loss."""
    lowest = F.min(F.when(F.col("val_loss") < FIRST_BEST_LOSS, F.struct("val_loss", "epoch")))
    return history.groupBy(run).agg(lowest.alias("_b")).select(run, F.col("_b.epoch").alias("epoch"), F.col("_b.val_loss").alias("val_loss"))
