"""Entity tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "references": T.StructType(
        [
            T.StructField("reference_id", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("original_file_data", T.BinaryType()),
            T.StructField("processed_image_data", T.BinaryType()),
            T.StructField("feature_data", T.StringType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("created_at", T.TimestampNTZType()),
        ]
    ),
    "ref_segments": T.StructType(
        [T.StructField("reference_id", T.LongType())]
        + [T.StructField(n, T.IntegerType()) for n in ("ref_id", "x1", "y1", "x2", "y2")]
    ),
    "uploads": T.StructType(
        [
            T.StructField("drawing_id", T.LongType()),
            T.StructField("original_filename", T.StringType()),
            T.StructField("original_file_data", T.BinaryType()),
            T.StructField("processed_image_data", T.BinaryType()),
            T.StructField("image_hash", T.StringType()),
            T.StructField("uploader", T.StringType()),
            T.StructField("uploaded_at", T.TimestampNTZType()),
        ]
    ),
    "segments": T.StructType(
        [T.StructField("drawing_id", T.LongType())]
        + [T.StructField(n, T.IntegerType()) for n in ("line_id", "x1", "y1", "x2", "y2")]
    ),
    "evaluations": T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("image_id", T.LongType()),
            T.StructField("reference_id", T.LongType()),
            T.StructField("correct_lines", T.IntegerType()),
            T.StructField("missing_lines", T.IntegerType()),
            T.StructField("extra_lines", T.IntegerType()),
            T.StructField("similarity_score", T.DoubleType()),
            T.StructField("user_evaluated", T.BooleanType()),
            T.StructField("evaluated_correct", T.IntegerType()),
            T.StructField("evaluated_missing", T.IntegerType()),
            T.StructField("evaluated_extra", T.IntegerType()),
            T.StructField("evaluated_at", T.TimestampNTZType()),
        ]
    ),
    "test_cases": T.StructType(
        [
            T.StructField("test_id", T.LongType()),
            T.StructField("test_name", T.StringType()),
            T.StructField("image_data", T.BinaryType()),
            T.StructField("expected_correct", T.IntegerType()),
            T.StructField("expected_missing", T.IntegerType()),
            T.StructField("expected_extra", T.IntegerType()),
            T.StructField("created_at", T.TimestampNTZType()),
        ]
    ),
    "training_drawings": T.StructType(
        [
            T.StructField("drawing_id", T.LongType()),
            T.StructField("patient_id", T.StringType()),
            T.StructField("task_type", T.StringType()),
            T.StructField("source_format", T.StringType()),
            T.StructField("test_name", T.StringType()),
            T.StructField("original_filename", T.StringType()),
            T.StructField("original_file_data", T.BinaryType()),
            T.StructField("processed_image_data", T.BinaryType()),
            T.StructField("image_hash", T.StringType()),
            T.StructField("extraction_metadata", T.StringType()),
            T.StructField("ground_truth_correct", T.IntegerType()),
            T.StructField("ground_truth_extra", T.IntegerType()),
            T.StructField("features_data", T.StringType()),
            T.StructField("session_id", T.StringType()),
            T.StructField("uploaded_at", T.TimestampNTZType()),
        ]
    ),
    "trail_points": T.StructType(
        [
            T.StructField("drawing_id", T.LongType()),
            T.StructField("stroke_id", T.StringType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("x", T.DoubleType()),
            T.StructField("y", T.DoubleType()),
            T.StructField("t", T.TimestampNTZType()),
        ]
    ),
}

# blobs stay out of statistics scans by column pruning; these columns make directories
PARTITIONS = {"training_drawings": ["source_format", "task_type"]}


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All rows of an entity; with a known name its schema is fixed, not inferred."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(path)


def read_trails(spark: SparkSession, path: str) -> DataFrame:
    return trails_with_area(read_table(spark, path))


def trails_with_area(points: DataFrame) -> DataFrame:
    """Points with their drawing area (0, 0, 568, 568 where none is recorded)."""
    # fixed values: default drawing area
    default = {"area_x": 0, "area_y": 0, "area_w": 568, "area_h": 568}
    return points.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in points.columns else F.lit(value)
            for name, value in default.items()
        }
    )


def trail_summary(points: DataFrame) -> DataFrame:
    """Strokes and points per recording."""
    strokes = points.groupBy("drawing_id", "stroke_id").agg(F.count(F.lit(1)).alias("n"))
    return strokes.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("strokes"), F.sum("n").alias("points"))


def read_test_cases(cases: DataFrame, newest: int | None = None) -> DataFrame:
    """All cases by id, or the newest ones."""
    if newest is None:
        return cases.orderBy("test_id")
    return cases.orderBy(F.desc("created_at"), F.desc("test_id")).limit(newest)
