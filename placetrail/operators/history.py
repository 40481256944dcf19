"""Analytics of training histories: one row per model and epoch with losses, accuracies and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_means(batches: DataFrame) -> DataFrame:
    """Size-weighted means per model and epoch: model, epoch, loss, acc, n, of batches with loss, acc, n."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    return batches.groupBy("model", "epoch").agg(mean("loss").alias("loss"), mean("acc").alias("acc"), F.sum("n").alias("n"))


def running_minimum(history: DataFrame) -> DataFrame:
    """The least loss before each epoch (infinity at first), and whether the epoch improves on it strictly."""
    before = Window.partitionBy("model").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    least = F.coalesce(F.min("loss").over(before), F.lit(float("inf")))
    return history.withColumn("least_before", least).withColumn("improved", F.col("loss") < F.col("least_before"))


def early_stopping(history: DataFrame, patience: int = 5) -> DataFrame:
    """The epochs that are run: with the streak of epochs without improvement, up to the first one that reaches ``patience``."""
    w = Window.partitionBy("model").orderBy("epoch")
    island = F.sum(F.col("improved").cast("int")).over(w)
    flagged = running_minimum(history).withColumn("island", island)
    streak = F.sum((~F.col("improved")).cast("int")).over(Window.partitionBy("model", "island").orderBy("epoch"))
    stops = F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).over(Window.partitionBy("model"))
    out = flagged.withColumn("streak", streak).withColumn("stop", stops)
    return out.where(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop"))).drop("island")


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of least loss of each model, the first one on ties, with its loss and accuracy and the last accuracy."""
    return history.groupBy("model").agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"),
        F.min("loss").alias("best_loss"),
        F.min_by("acc", F.struct("loss", "epoch")).alias("best_acc"),
        F.max_by("acc", "epoch").alias("last_acc"),
    )


def epoch_timing(stamped: DataFrame) -> DataFrame:
    """Seconds from the first to the last stamp of each model, and per epoch by both published divisors.

    ``per_epoch_stopped`` divides by the number of epochs, ``per_epoch_ended`` by one less (null for a single epoch).
    """
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6
    n = F.count_distinct("epoch")
    return stamped.groupBy("model").agg(
        seconds.alias("total_s"),
        n.alias("epochs"),
        F.try_divide(seconds, n).alias("per_epoch_stopped"),
        F.try_divide(seconds, n - 1).alias("per_epoch_ended"),
    )
