"""Ingest: duplicate checks, deduplication, label files, evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.functions import labels as L
from strokelake.functions.names import escape_markup, hash_prefix
from strokelake.functions.values import content_hash
from strokelake.operators.profile import count_rows


def with_hash(df: DataFrame, original: str = "original_file_data", processed: str = "processed_image_data") -> DataFrame:
    return df.withColumn("image_hash", content_hash(F.col(original), F.col(processed)))


def first_of_hash(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("image_hash",)) -> DataFrame:
    """The first row of each hash.

    Only the ordering columns are aggregated (map-side, so copies of one file never meet in one
    task); the full rows, with their bytes, are picked afterwards by that order.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f")).select(
        *keys, *(F.col(f"_f.{c}").alias(c) for c in order)
    )
    return df.join(first, [*order, *keys], "left_semi")


def dedup_ingest(batch: DataFrame, stored: DataFrame, order: Sequence[str] = ("uploaded_seq", "drawing_id")) -> DataFrame:
    """Drop rows whose hash is stored already; the first of equal rows inside the batch wins.

    A row without a hash has no content to store; ``file_status`` reports it as an error.
    """
    known = stored.select("image_hash").distinct()
    batch = batch.where(F.col("image_hash").isNotNull())
    winners = batch.groupBy("image_hash").agg(F.min(F.struct(*order)).alias("_f"))
    fresh = winners.join(known, "image_hash", "left_anti").select(
        "image_hash", *(F.col(f"_f.{c}").alias(c) for c in order)
    )
    return batch.join(fresh, [*order, "image_hash"], "left_semi")


def dedup_by_source(batch: DataFrame, stored: DataFrame, recordings: str = "MAT") -> DataFrame:
    """Recordings are known by source, file name and hash; every other source by source and hash.

    One key expression serves both rules, so one anti-join over distinct stored keys is enough.
    """
    name = F.when(F.col("source_format") == recordings, F.col("original_filename")).otherwise("")
    key = [F.col("source_format"), name.alias("_name"), F.col("image_hash")]
    known = stored.select(*key).distinct()
    return batch.withColumn("_name", name).join(known, ["source_format", "_name", "image_hash"], "left_anti").drop("_name")


def _spread_hash(key: str = "drawing_id") -> Column:
    """The hash as a join key; rows without one get a key of their own instead of meeting in one task."""
    return F.coalesce(F.col("image_hash"), F.concat(F.lit("none-"), F.col(key).cast("string")))


def duplicate_report(batch: DataFrame, uploads: DataFrame, training: DataFrame) -> DataFrame:
    """Where each batch row is stored already; the upload catalogue has priority."""
    up = uploads.where(F.col("image_hash").isNotNull()).groupBy(F.col("image_hash").alias("_key")).agg(F.min_by(F.struct("drawing_id", "original_filename", "uploaded_at"), "drawing_id").alias("u"))
    name = F.coalesce("original_filename", F.concat_ws("_", "patient_id", "task_type"))
    tr = training.where(F.col("image_hash").isNotNull()).groupBy(F.col("image_hash").alias("_key")).agg(
        F.min_by(F.struct("drawing_id", name.alias("shown"), "uploaded_at"), "drawing_id").alias("t")
    )
    hit = batch.withColumn("_key", _spread_hash()).join(up, "_key", "left").join(tr, "_key", "left")
    found_u, found_t = F.col("u").isNotNull(), F.col("t").isNotNull()
    return hit.select(
        F.col("drawing_id"),
        (found_u | found_t).alias("is_duplicate"),
        F.when(found_u, "upload").when(found_t, "training").alias("found_in"),
        F.when(found_u, F.col("u.drawing_id")).otherwise(F.col("t.drawing_id")).alias("stored_id"),
        F.when(found_u, F.col("u.original_filename")).otherwise(F.col("t.shown")).alias("stored_name"),
        F.when(found_u, F.col("u.uploaded_at")).otherwise(F.col("t.uploaded_at")).alias("stored_at"),
        hash_prefix(F.col("image_hash")).alias("hash_prefix"),
    )


check_duplicates = duplicate_report


def name_conflicts(batch: DataFrame, stored: DataFrame, name: str = "test_name") -> DataFrame:
    return batch.join(stored.select(name).distinct(), name, "left_semi")


def latest_evaluation(evals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Newest evaluation of each drawing; the higher id wins a tie."""
    newest = F.max_by(F.struct("id", "evaluated_at", *columns), F.struct("evaluated_at", "id"))
    return evals.groupBy("image_id").agg(newest.alias("e")).select("image_id", "e.*")


def join_ratings_files(ratings: DataFrame, original: DataFrame, normalised: DataFrame) -> DataFrame:
    """Ratings with both of their files; ``missing`` names what is absent (null when complete)."""
    name = F.concat(F.col("id"), F.lit("_"), F.col("cond"), F.lit(".png"))
    rows = ratings.withColumn("filename", name)
    o = original.select("filename", F.lit(True).alias("_o")).distinct()
    n = normalised.select("filename", F.lit(True).alias("_n")).distinct()
    missing = F.when(F.col("_o").isNull(), "original").when(F.col("_n").isNull(), "normalised")
    return rows.join(o, "filename", "left").join(n, "filename", "left").withColumn("missing", missing).drop("_o", "_n")


def apply_label_csv(drawings: DataFrame, csv: DataFrame, key: str = "drawing_id") -> tuple[DataFrame, DataFrame]:
    """Set the two scores of each line's drawing; returns the drawings and one report row per line.

    ``csv`` carries ``line_no, Patient, Task, Total_Score, Data_Quality``. Patient and task match
    without regard to case, the drawing with the lowest id is meant, and later lines win.
    """
    def trimmed(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    lines = csv.select(
        "line_no",
        trimmed("Patient").alias("patient"),
        trimmed("Task").alias("task"),
        trimmed("Total_Score").alias("score_text"),
        trimmed("Data_Quality").alias("quality_text"),
    )
    named = (F.col("patient") != "") & (F.col("task") != "")
    # a line that names no drawing gets a key of its own, so that such lines do not meet in one task
    own = F.concat(F.lit("-"), F.col("line_no").cast("string"))
    lines = lines.withColumns({"_p": F.when(named, F.lower("patient")).otherwise(own), "_t": F.lower("task")})
    targets = drawings.groupBy(F.lower("patient_id").alias("_p"), F.lower("task_type").alias("_t")).agg(
        F.min(key).alias(key)
    )
    # json null/NaN never appear: text that is no number is an error
    score, quality = F.col("score_text").try_cast("double"), F.col("quality_text").try_cast("double")
    who = F.concat(escape_markup(F.col("patient")), F.lit("/"), escape_markup(F.col("task")))

    def error(name: str, text: str, number: Column) -> Column:
        shown = F.concat(who, F.lit(f": Invalid {name} '"), escape_markup(F.col(text)), F.lit("'"))
        return F.when(F.col(key).isNotNull() & (F.col(text) != "") & number.isNull(), shown)

    found = lines.join(targets, ["_p", "_t"], "left").withColumn(key, F.when(named, F.col(key)))
    good = F.col(key).isNotNull() & (score.isNotNull() | quality.isNotNull())
    report = found.select(
        "line_no",
        key,
        F.when(good, "updated").otherwise("skipped").alias("status"),
        F.concat_ws("; ", error("Total_Score", "score_text", score), error("Data_Quality", "quality_text", quality)).alias("errors"),
        score.alias("score"),
        quality.alias("quality"),
    )
    last = report.where(F.col("status") == "updated").groupBy(key).agg(
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("line_no"))).alias("_score"),
        F.max_by("quality", F.when(F.col("quality").isNotNull(), F.col("line_no"))).alias("_quality"),
    )
    joined = drawings.join(last, key, "left")
    # an unreadable bag starts anew
    bag = F.when(L.label_map(F.col("features_data")).isNull(), F.lit("{}")).otherwise(F.col("features_data"))
    bag = F.when(F.col("_score").isNotNull(), L.put_label(bag, "Total_Score", F.col("_score").cast("string"))).otherwise(bag)
    bag2 = F.when(F.col("_quality").isNotNull(), L.put_label(F.col("_bag"), "Data_Quality", F.col("_quality").cast("string"))).otherwise(F.col("_bag"))
    touched = F.col("_score").isNotNull() | F.col("_quality").isNotNull()
    updated = joined.withColumn("_bag", bag).withColumn("features_data", F.when(touched, bag2).otherwise(F.col("features_data")))
    return updated.drop("_bag", "_score", "_quality"), report.drop("score", "quality")


def csv_report_counts(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(F.col("status") == "updated").alias("updated"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("errors") != "").alias("lines_with_errors"),
        count_rows().alias("total_rows"),
    )


def file_status(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file: success, duplicate or error, and the images it yields."""
    known = stored.where(F.col("image_hash").isNotNull()).select(F.col("image_hash").alias("_key"), F.lit(True).alias("_known")).distinct()
    keyed = batch.withColumn("_key", _spread_hash())
    first = batch.where(F.col("image_hash").isNotNull()).groupBy(F.col("image_hash").alias("_key")).agg(F.min("drawing_id").alias("_first"))
    rows = keyed.join(first, "_key", "left").join(known, "_key", "left")
    status = (
        F.when(F.col("image_hash").isNull(), "error")
        .when(F.col("_known") | (F.col("_first") != F.col("drawing_id")), "duplicate")
        .otherwise("success")
    )
    return rows.select(
        "drawing_id", "original_filename", status.alias("status"),
        F.when(status == "success", F.coalesce("images", F.lit(1))).otherwise(0).alias("images_extracted"),
    )


def ingest_report(status: DataFrame) -> DataFrame:
    return status.agg(
        count_rows().alias("files"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "duplicate", "error")),
        F.sum("images_extracted").alias("images_extracted"),
    )


def drop_templates(df: DataFrame) -> DataFrame:
    """Recordings bring the template along; it is not stored as a drawing."""
    return df.where(~((F.col("source_format") == "MAT") & (F.col("task_type") == "REFERENCE")))
