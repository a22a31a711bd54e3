"""Writers: append, snapshot, augmented sets, label templates, resets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strokelake.functions.names import session_id
from strokelake.functions.values import content_hash
from strokelake.operators.augment import augmentation_stats
from strokelake.sources.tables import PARTITIONS, SCHEMAS


def append_drawings(df: DataFrame, path: str, prefix: str = "extract") -> None:
    """Append ingested rows; hash, session and upload time are derived where absent.

    Rows are spread over (source, task) directories by the writer; a rebalance keeps file sizes
    even when one source holds most rows.
    """
    rows = df
    if "image_hash" not in rows.columns:
        rows = rows.withColumn("image_hash", content_hash(F.col("original_file_data"), F.col("processed_image_data")))
    if "session_id" not in rows.columns:
        rows = rows.withColumn("session_id", session_id(prefix))
    if "uploaded_at" not in rows.columns:
        rows = rows.withColumn("uploaded_at", F.current_timestamp().cast("timestamp_ntz"))
    keys = PARTITIONS["training_drawings"]
    rows.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)


def publish_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a new snapshot of an entity and point ``<root>/_current/<name>`` at it.

    The old snapshot stays readable until the pointer has moved, so an update may read and
    replace the same entity.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{name}/snapshot-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if name in PARTITIONS:
        writer = writer.partitionBy(*PARTITIONS[name])
    writer.parquet(path)
    pointer = spark.range(1).select(F.lit(path).alias("path"))
    pointer.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/_current/{name}")
    return path


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = spark.read.json(f"{root.rstrip('/')}/_current/{name}").first()["path"]
    return spark.read.parquet(path)


def write_augmented(samples: DataFrame, path: str) -> None:
    """Replace an augmented set: one directory per split, statistics next to it."""
    samples.write.mode("overwrite").partitionBy("split").parquet(f"{path.rstrip('/')}/samples")
    written = samples.sparkSession.read.parquet(f"{path.rstrip('/')}/samples")
    augmentation_stats(written).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/stats")


def label_template(df: DataFrame) -> DataFrame:
    """Rows of the label file: present scores or blanks, by patient and task."""
    def text(key: str):
        return F.coalesce(F.get_json_object("features_data", f"$.{key}"), F.lit(""))

    return df.select(
        F.col("patient_id").alias("Patient"),
        F.col("task_type").alias("Task"),
        text("Total_Score").alias("Total_Score"),
        text("Data_Quality").alias("Data_Quality"),
    ).orderBy("Patient", "Task")


def export_label_template(df: DataFrame, path: str) -> None:
    label_template(df).write.mode("overwrite").option("header", "true").csv(path)


def reset_tables(spark: SparkSession, root: str, confirm: str, names: list[str] | None = None) -> list[str]:
    """Empty every entity but keep its schema; needs the confirmation word."""
    if confirm != "RESET":
        raise ValueError("reset needs confirm='RESET'")
    done = names or [n for n in SCHEMAS]
    for name in done:
        publish_snapshot(spark.createDataFrame([], SCHEMAS[name]), root, name)
    return done
