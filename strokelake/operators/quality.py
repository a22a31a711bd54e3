"""Validation of stored rows against ratings, files and configuration rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.config import CANVAS
from strokelake.functions.values import content_hash
from strokelake.operators.profile import count_rows

RATED = ["patient_id", "task_type"]


def validate_scores(stored: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per stored row the findings against the ratings: no rating, other score.

    Both sides carry ``patient_id, task_type, total_score``; the join is on the two key columns,
    so ids holding ``_`` are safe.
    """
    expected = ratings.groupBy(*RATED).agg(F.max("total_score").alias("expected_score"), F.lit(True).alias("_in"))
    rows = stored.join(expected, RATED, "left")
    key = F.concat_ws("_", *RATED)
    mismatch = ~F.col("total_score").eqNullSafe(F.col("expected_score"))
    errors = F.array_compact(
        F.array(
            F.when(F.col("_in").isNull(), F.concat(F.lit("Entry not found in CSV: "), key)),
            F.when(
                F.col("_in") & mismatch,
                F.concat(
                    F.lit("TotalScore mismatch: expected "), F.col("expected_score"),
                    F.lit(", got "), F.coalesce(F.col("total_score").cast("string"), F.lit("None")),
                ),
            ),
        )
    )
    return rows.withColumn("errors", errors).drop("_in")


def validate_fields(stored: DataFrame, source: str = "OXFORD") -> DataFrame:
    """Source and task of a rated entry."""
    errors = F.array_compact(
        F.array(
            F.when(F.col("source_format") != source, F.concat(F.lit(f"source_format should be '{source}', got '"), F.col("source_format"), F.lit("'"))),
            F.when(
                ~F.col("task_type").isin("COPY", "RECALL"),
                F.concat(F.lit("task_type should be 'COPY' or 'RECALL', got '"), F.col("task_type"), F.lit("'")),
            ),
        )
    )
    return stored.withColumn("errors", errors)


def validate_files(stored: DataFrame, original: DataFrame, normalised: DataFrame) -> DataFrame:
    """Existence and size of both files, and the hash of the original's bytes.

    File sides carry ``original_filename, length, image_hash``; stored rows carry the byte
    lengths ``original_length, processed_length`` and ``image_hash``.
    """
    def side(files: DataFrame, mark: str) -> DataFrame:
        return files.groupBy("original_filename").agg(
            F.max(F.struct("length", "image_hash")).alias(mark)
        )

    rows = stored.join(side(original, "_o"), "original_filename", "left").join(side(normalised, "_n"), "original_filename", "left")
    errors = F.array_compact(
        F.array(
            F.when(F.col("_o").isNull(), F.lit("Original file not found")),
            F.when(F.col("_n").isNull(), F.lit("Normalized file not found")),
            F.when(F.col("_o.image_hash") != F.col("image_hash"), F.lit("Image hash mismatch")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_o.length") != F.col("original_length"), F.lit("Original file size mismatch")),
            F.when(F.col("_n.length") != F.col("processed_length"), F.lit("Normalized file size mismatch")),
        )
    )
    return rows.withColumns({"errors": errors, "warnings": warnings}).drop("_o", "_n")


def validation_report(checked: DataFrame) -> DataFrame:
    """Valid, erroneous and warned rows with shares; a row with errors is not counted as warned."""
    bad = F.size("errors") > 0
    warned = ~bad & (F.size("warnings") > 0) if "warnings" in checked.columns else F.lit(False)
    return checked.agg(
        count_rows().alias("total"),
        F.count_if(~bad).alias("valid"),
        F.count_if(bad).alias("errors"),
        F.count_if(warned).alias("warnings"),
        F.min("total_score").alias("min_score"),
        F.max("total_score").alias("max_score"),
        F.count_if(F.col("task_type") == "COPY").alias("copy_rows"),
        F.count_if(F.col("task_type") == "RECALL").alias("recall_rows"),
    ).withColumns(
        {
            "valid_pct": F.when(F.col("total") > 0, F.round(F.col("valid") * 100.0 / F.col("total"), 2)),
            "error_pct": F.when(F.col("total") > 0, F.round(F.col("errors") * 100.0 / F.col("total"), 2)),
        }
    )


def validation_errors(checked: DataFrame, keys: Sequence[str] = tuple(RATED)) -> DataFrame:
    return checked.select(*keys, F.explode("errors").alias("error"))


def missing_keys(ratings: DataFrame, stored: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rated keys without a stored row; with ``files``, only those that have one."""
    gone = ratings.select(*RATED).distinct().join(stored.select(*RATED).distinct(), RATED, "left_anti")
    if files is None:
        return gone
    name = F.concat(F.concat_ws("_", *RATED), F.lit(".png"))
    return gone.withColumn("filename", name).join(files.select("filename").distinct(), "filename", "left_semi").drop("filename")


def _range(column: str, low=None, high=None, low_open: bool = False) -> Column:
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | ((c <= low) if low_open else (c < low))
    if high is not None:
        bad = bad | (c > high)
    text = f"{column} out of range"
    return F.when(bad, F.lit(text))


def config_violations(df: DataFrame) -> DataFrame:
    """Findings of a training request; a row without findings is a valid request."""
    # fixed values: bounds of the request fields
    rules = [
        F.when(F.length("target_feature") < 1, F.lit("target_feature is empty")),
        _range("train_split", 0.1, 0.9),
        _range("num_epochs", 1, 1000),
        _range("learning_rate", 0, 0.1, low_open=True),
        _range("batch_size", 1, 128),
        _range("synthetic_n_samples", 0, 500),
        F.when(
            F.col("add_synthetic_bad_images") & (F.col("synthetic_n_samples") == 0),
            F.lit("synthetic_n_samples must be > 0 if add_synthetic_bad_images is enabled"),
        ),
        F.when(
            ~F.col("use_augmentation") & F.col("add_synthetic_bad_images"),
            F.lit("Cannot add synthetic images without augmentation enabled"),
        ),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def augmentation_violations(df: DataFrame) -> DataFrame:
    """Findings of an augmentation request: bounds and ordered ranges."""
    # fixed values: bounds of the request fields
    rules = [
        *(
            F.when(F.col(f"{name}_min") >= F.col(f"{name}_max"), F.lit(f"{name}: minimum must be less than maximum"))
            for name in ("rotation", "translation", "scale")
        ),
        _range("num_augmentations", 0, 20),
        _range("warping_displacement", 5, 30),
        _range("warping_control_points", 4, 16),
        _range("warping_ratio", 0, 1),
        _range("binarization_threshold", 0, 255),
        _range("line_thickness", 1, 5),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def synthesis_violations(df: DataFrame) -> DataFrame:
    """Findings of a synthesis request: bounds, and more lines at most than at least."""
    # fixed values: bounds of the request fields
    rules = [
        _range("n_samples", 0, 500),
        _range("complexity_levels", 1, 10),
        _range("score_threshold", 0, 60),
        _range("min_lines", 1, 50),
        _range("max_lines", 1, 50),
        F.when(F.col("max_lines") <= F.col("min_lines"), F.lit("max_lines must be greater than min_lines")),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))
