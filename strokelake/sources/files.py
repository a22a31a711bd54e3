"""File-backed sources: binary scans, images, CSV files, models, augmented sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strokelake.operators.ordered import numbered

RATINGS_SCHEMA = "ID string, Cond string, TotalScore double"
LABELS_SCHEMA = "Patient string, Task string, Total_Score string, Data_Quality string"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def scan_files(
    spark: SparkSession, folder: str, glob: str, tokens: Sequence[str] | None = None, content: bool = False
) -> DataFrame:
    """Files below a folder by name pattern, optionally holding one of the tokens in the name, sorted by path."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    )
    columns = ["path", "modificationTime", "length"] + (["content"] if content else [])
    rows = files.select(*columns, file_name(F.col("path")).alias("filename"))
    if tokens:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | F.upper("filename").contains(token.upper())
        rows = rows.where(hit)
    return rows.orderBy("path")


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded rasters; unreadable files are dropped by the reader."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    return images.select(file_stem(F.col("image.origin")).alias("name"), "image.*")


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RATINGS_SCHEMA).option("header", "true").csv(path)
    return rows.select(
        F.trim("ID").alias("patient_id"), F.upper(F.trim("Cond")).alias("task_type"), F.col("TotalScore").alias("total_score")
    )


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """``;`` when it occurs oftener than ``,`` on the first five lines, else ``,``."""
    head = [r["value"] for r in spark.read.text(path).limit(5).collect()]
    return ";" if sum(line.count(";") for line in head) > sum(line.count(",") for line in head) else ","


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label lines with their order (``line_no``) over all files of the path, by file name and place in the file."""
    sep = detect_delimiter(spark, path)
    rows = spark.read.option("header", "true").option("sep", sep).csv(path)
    known = [f.split(" ")[0] for f in LABELS_SCHEMA.split(", ")]
    columns = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in known]
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    return numbered(rows.select(*columns, *split), [], ["_file", "_start"]).drop("_file", "_start")


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    from strokelake.operators.catalog import model_listing

    models = scan_files(spark, folder, "*.pth").select(
        file_stem(F.col("path")).alias("stem"), "length", F.col("modificationTime").alias("modified")
    )
    return model_listing(models, metadata_files(spark, folder))


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    return scan_files(spark, folder, "*_metadata.json").select(
        F.regexp_replace(file_stem(F.col("path")), "_metadata$", "").alias("stem")
    )


def read_model_metadata(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """One row per metadata file: stem and the whole text, or parsed columns with a schema."""
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", "*_metadata.json").text(folder)
    stem = F.regexp_replace(file_stem(F.col("_metadata.file_path")), "_metadata$", "")
    rows = texts.select(stem.alias("stem"), F.col("value").alias("metadata"))
    if schema is None:
        return rows
    return rows.select("stem", F.from_json("metadata", schema).alias("m")).select("stem", "m.*")


def read_augmented(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One side of an augmented set; the split is a directory, so the other side is not read."""
    return spark.read.parquet(folder).where(F.col("split") == split)


def read_augmented_pairs(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Label files of one side that have an image partner of the same stem."""
    side = f"{folder.rstrip('/')}/{split}"
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(side)
    labels = texts.select(file_stem(F.col("_metadata.file_path")).alias("stem"), "value")
    images = scan_files(spark, side, "*.png").select(file_stem(F.col("path")).alias("stem"))
    return paired_labels(labels, images)


def paired_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    return labels.join(images.select("stem").distinct(), "stem", "left_semi")
