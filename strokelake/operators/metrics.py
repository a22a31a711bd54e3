"""Prediction, case and training metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.functions.values import clamp01
from strokelake.operators.profile import count_rows, one_row


def regression_metrics(pred: DataFrame, by: Sequence[str] = (), target="target", prediction="prediction") -> DataFrame:
    """MSE, RMSE, MAE, R2, MAPE (over non-zero targets) and row count, in one pass."""
    t, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    err = p - t
    sums = pred.groupBy(*by).agg(
        count_rows().alias("num_samples"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_res"),
        # spread about the mean by Spark's own stable merge, not by a difference of sums
        (F.var_pop(t) * F.count(t)).alias("_tot"),
        F.avg(F.when(t != 0, F.abs(err / t))).alias("_ape"),
    )
    return sums.select(
        *by,
        "num_samples",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.when(F.col("_tot") != 0, 1 - F.col("_res") / F.col("_tot")).otherwise(0.0).alias("r2"),
        F.coalesce(F.col("_ape") * 100, F.lit(0.0)).alias("mape"),
    )


def metric_sample(pred: DataFrame, n: int = 1000, order: Sequence[str] = ("id",)) -> DataFrame:
    """The first rows kept next to the metrics."""
    return pred.orderBy(*order).limit(n)


def confusion_matrix(pred: DataFrame, k: int) -> DataFrame:
    """Dense k x k counts, empty cells included."""
    cells = pred.groupBy(F.col("target").cast("int").alias("target"), F.col("prediction").cast("int").alias("prediction")).agg(
        count_rows().alias("n")
    )
    grid = pred.sparkSession.range(k * k).select(
        F.floor(F.col("id") / k).cast("int").alias("target"), (F.col("id") % k).cast("int").alias("prediction")
    )
    return grid.join(cells, ["target", "prediction"], "left").na.fill(0, ["n"])


def class_metrics(pred: DataFrame, k: int) -> DataFrame:
    """Per class precision, recall, F1 and support; zero on empty denominators."""
    cells = confusion_matrix(pred, k)
    hit = F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(0)
    rows = cells.groupBy(F.col("target").alias("class_id")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    columns = cells.groupBy(F.col("prediction").alias("class_id")).agg(F.sum("n").alias("predicted"))
    both = rows.join(columns, "class_id")
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return both.select(
        "class_id", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp"
    )


def classification_metrics(pred: DataFrame, k: int) -> DataFrame:
    """One row: accuracy, macro F1 over all k classes, row count."""
    whole = one_row(
        pred.agg(count_rows().alias("n"), F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("accuracy"))
    )
    return class_metrics(pred, k).agg(F.avg("f1").alias("macro_f1")).select(
        whole["accuracy"].alias("accuracy"), "macro_f1", whole["n"].alias("num_samples")
    )


def evaluate_model(pred: DataFrame, mode: str, k: int | None = None, split: str = "split") -> DataFrame:
    """Metrics per split for either training mode."""
    if mode == "regression":
        return regression_metrics(pred, [split])
    hit = (F.col("target") == F.col("prediction")).cast("double")
    cells = pred.groupBy(split, "target", "prediction").agg(count_rows().alias("n"))
    support = cells.groupBy(split, F.col("target").alias("class_id")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp")
    )
    guessed = cells.groupBy(split, F.col("prediction").alias("class_id")).agg(F.sum("n").alias("predicted"))
    f1 = F.coalesce(2.0 * F.col("tp") / (F.coalesce("support", F.lit(0)) + F.coalesce("predicted", F.lit(0))), F.lit(0.0))
    macro = support.join(guessed, [split, "class_id"], "full").groupBy(split).agg((F.sum(f1) / k).alias("macro_f1"))
    accuracy = pred.groupBy(split).agg(count_rows().alias("num_samples"), F.avg(hit).alias("accuracy"))
    return accuracy.join(macro, split)


def overfit_summary(metrics: DataFrame, split: str = "split") -> DataFrame:
    """Gap between the training and the validation side."""

    def side(name: str, which: str) -> Column:
        return F.max(F.when(F.col(split) == which, F.col(name)))

    have = metrics.columns
    gaps = []
    if "r2" in have:
        gaps.append(F.abs(side("r2", "train") - side("r2", "val")).alias("r2_difference"))
        gaps.append((side("rmse", "val") / F.greatest(side("rmse", "train"), F.lit(0.0001))).alias("rmse_ratio"))
    if "accuracy" in have:
        gaps.append(F.abs(side("accuracy", "train") - side("accuracy", "val")).alias("accuracy_difference"))
    return metrics.agg(*gaps)


def epoch_loss(batches: DataFrame) -> DataFrame:
    return batches.groupBy("model", "epoch", "phase").agg(F.avg("loss").alias("loss"))


def training_eta(history: DataFrame, total_epochs: int) -> DataFrame:
    """Mean seconds per epoch so far and the estimate for the epochs left.

    A model has at most 1000 epochs, so a window per model is small.
    """
    sofar = W.partitionBy("model").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    mean = F.avg("seconds").over(sofar)
    return history.select(
        "model", "epoch", "seconds", mean.alias("mean_seconds"), (mean * (total_epochs - F.col("epoch"))).alias("remaining_seconds")
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """First epoch with the lowest validation loss."""
    best = F.min(F.struct("val_loss", "epoch"))
    return history.groupBy("model").agg(best.alias("b")).select(
        "model", F.col("b.epoch").alias("epoch"), F.col("b.val_loss").alias("val_loss")
    )


def first_per_class(df: DataFrame, label: str, key: str, columns: Sequence[str]) -> DataFrame:
    """The record with the smallest key of each label."""
    return df.groupBy(label).agg(F.min(key).alias(key), F.min_by(F.struct(*columns), F.col(key)).alias("_r")).select(
        label, key, *(F.col(f"_r.{c}").alias(c) for c in columns)
    )


def expected_vs_actual(cases: DataFrame, evals: DataFrame, key: str = "test_id") -> DataFrame:
    return cases.join(evals, key, "inner")


def score_cases(df: DataFrame, reference_lines: int | Column) -> DataFrame:
    """Signed differences, detection score and prediction accuracy per case."""
    ref = F.lit(reference_lines) if isinstance(reference_lines, int) else reference_lines
    diffs = {n: F.col(f"{n}_lines") - F.col(f"expected_{n}") for n in ("correct", "missing", "extra")}
    hits = F.greatest(F.col("correct_lines") - F.col("extra_lines"), F.lit(0))
    off = F.abs(diffs["correct"]) + F.abs(diffs["missing"]) + F.abs(diffs["extra"])
    return df.select(
        "*",
        *(c.alias(f"{n}_diff") for n, c in diffs.items()),
        F.when(ref > 0, clamp01(hits / ref)).otherwise(0.0).alias("detection_score"),
        F.when(ref > 0, clamp01(1.0 - off / (3.0 * ref))).otherwise(1.0).alias("prediction_accuracy"),
    )


def suite_stats(scored: DataFrame) -> DataFrame:
    """Suite totals; a case without a score counts as failed."""
    done = F.col("detection_score").isNotNull()
    return scored.agg(
        count_rows().alias("total_tests"),
        F.count_if(done).alias("successful"),
        F.count_if(~done).alias("failed"),
        F.coalesce(F.avg("detection_score"), F.lit(0.0)).alias("average_detection_score"),
        F.coalesce(F.avg("prediction_accuracy"), F.lit(0.0)).alias("average_prediction_accuracy"),
        F.count_if(F.col("detection_score") == 1.0).alias("perfect_detections"),
        F.count_if(F.col("prediction_accuracy") == 1.0).alias("perfect_predictions"),
        *(F.avg(F.abs(F.col(f"{n}_diff"))).alias(f"average_{n}_diff") for n in ("correct", "missing", "extra")),
    )


def ground_truth_accuracy(df: DataFrame, reference_lines: int) -> DataFrame:
    """Agreement of detected counts with the human counts; null without a human count."""
    truth = F.col("ground_truth_correct")
    correct = F.abs(F.col("correct_lines") - truth)
    missing = F.abs(F.col("missing_lines") - (reference_lines - truth))
    extra = F.abs(F.col("extra_lines") - F.coalesce("ground_truth_extra", F.lit(0)))
    off = correct + missing + extra
    score = F.greatest(F.lit(0.0), 1.0 - off / (3.0 * reference_lines)) if reference_lines > 0 else F.lit(1.0)
    return df.select(
        "*",
        F.when(truth.isNotNull(), off).alias("total_error"),
        F.when(truth.isNotNull(), score).alias("ground_truth_accuracy"),
    )
