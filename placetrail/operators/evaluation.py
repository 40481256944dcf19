"""Binary evaluation, by group: accuracy, F1, confusion matrix, ROC curve and AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrail.operators.prefix import running_totals


def confusion(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of each actual (0, 1) against each prediction, one row per actual value, zero cells kept: n_pred_0, n_pred_1.

    Rows with a null actual or prediction are left out.
    """
    keys = keys or []
    cells = df.where("actual is not null and pred is not null").groupBy(*keys).agg(
        *(F.count_if((F.col("actual") == a) & (F.col("pred") == p)).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1))
    )
    rows = F.array(*(F.struct(F.lit(a).alias("actual"), F.col(f"c{a}0").alias("n_pred_0"), F.col(f"c{a}1").alias("n_pred_1")) for a in (0, 1)))
    return cells.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def accuracy_f1(df: DataFrame, keys: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """n, accuracy and f1 (positive is 1; 0 where nothing is positive), by group; with ``rollup`` also over all (null keys)."""
    keys = keys or []
    known = df.where("actual is not null and pred is not null")
    groups = known.rollup(*keys) if rollup else known.groupBy(*keys)
    tp = F.count_if((F.col("actual") == 1) & (F.col("pred") == 1))
    wrong = F.count_if(F.col("actual") != F.col("pred"))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0))
    return groups.agg(F.count("*").alias("n"), F.avg((F.col("actual") == F.col("pred")).cast("int")).alias("accuracy"), f1.alias("f1"))


def _by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score: ties are together, and sorting sees distinct scores only."""
    return df.where("actual is not null and score is not null").groupBy("score").agg(
        F.sum("actual").cast("double").alias("pos"), F.sum(1 - F.col("actual")).cast("double").alias("neg")
    )


def roc_curve(df: DataFrame) -> DataFrame:
    """Points of the curve, one per distinct score from the highest on, and the origin: threshold, fpr, tpr.

    All points are kept, collinear ones too; the origin has the threshold infinity.
    """
    ranked = running_totals(_by_score(df).withColumn("down", -F.col("score")), ["down"], ["pos", "neg"])
    total = df.where("actual is not null and score is not null").agg(
        F.sum("actual").alias("p"), F.sum(1 - F.col("actual")).alias("n")
    )
    points = ranked.crossJoin(F.broadcast(total)).select(  # one row
        F.col("score").alias("threshold"), F.try_divide("run_neg", "n").alias("fpr"), F.try_divide("run_pos", "p").alias("tpr")
    )
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the curve by ranks, half for ties: auc (null without both classes)."""
    ranked = running_totals(_by_score(df), ["score"], ["neg"])
    won = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2))
    return ranked.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def against_truth(loops: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Every frame of ``truth`` (key, actual) with pred 1 if it was reported, else 0."""
    hit = loops.select(key).distinct().withColumn("pred", F.lit(1))
    return truth.join(hit, key, "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


