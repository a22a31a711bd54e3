"""Model catalogue: listing, metadata, prediction finishing, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.functions import labels as L
from strokelake.functions.names import parse_model_name
from strokelake.functions.values import denormalise, softmax, top_class
from strokelake.operators.keyed import join_small
from strokelake.operators.profile import count_rows, one_row
from strokelake.session import cut


def model_listing(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """Models (``stem, length, modified``) with parsed names and whether metadata exists, newest first."""
    has = metadata.select("stem", F.lit(True).alias("_m")).distinct()
    parsed = parse_model_name(F.col("stem"))
    return (
        models.join(has, "stem", "left")
        .select(
            "stem",
            parsed["feature"].alias("feature"),
            parsed["timestamp"].alias("timestamp"),
            (F.col("length") / 1048576.0).alias("size_mb"),
            "modified",
            F.col("_m").isNotNull().alias("has_metadata"),
        )
        .orderBy(F.desc("modified"), "stem")
    )


def orphan_metadata(metadata: DataFrame, models: DataFrame) -> DataFrame:
    return metadata.join(models.select("stem").distinct(), "stem", "left_anti")


def resolve_mode(models: DataFrame) -> DataFrame:
    """Training mode, class count and feature of each model, from the best source available.

    Rows carry ``stem`` and the metadata fields ``target_feature, training_mode, num_classes,
    output_neurons`` (null without metadata). Metadata counts only when both its feature and its
    output count are there; then its mode, else the feature name; otherwise the file name.
    """
    usable = F.col("target_feature").isNotNull() & (F.col("target_feature") != "") & F.col("output_neurons").isNotNull()
    feature = F.when(usable, F.col("target_feature")).otherwise(parse_model_name(F.col("stem"))["feature"])
    prefix = f"{L.CLASS_KEY}_"
    named = feature.startswith(prefix)
    from_name = F.when(named, F.substring(feature, len(prefix) + 1, 9).try_cast("int"))
    stored = usable & F.col("training_mode").isNotNull() & (F.col("training_mode") != "")
    mode = F.when(stored, F.col("training_mode")).when(named, "classification").otherwise("regression")
    count = F.when(
        stored, F.coalesce(F.when(F.col("num_classes") > 0, F.col("num_classes")), from_name, F.col("output_neurons"))
    ).otherwise(from_name)
    source = F.when(stored, "metadata").when(usable, "feature").otherwise("filename")
    return models.select(
        "stem",
        feature.alias("feature"),
        mode.alias("mode"),
        F.when(mode == "classification", count).cast("int").alias("num_classes"),
        source.alias("source"),
    )


def class_info(drawings: DataFrame, k: int, key: str = "drawing_id") -> DataFrame:
    """Stored name and edges per class label, from the drawing with the smallest id."""
    rows = drawings.where(L.is_labelled(F.col("features_data"))).select(
        key, F.try_element_at(L.class_map(F.col("features_data")), F.lit(str(k))).alias("c")
    ).where(F.col("c").isNotNull())
    return rows.groupBy(F.col("c.label").alias("label")).agg(F.min_by("c", F.col(key)).alias("c")).select(
        "label", F.col("c.name_custom").alias("name"), F.col("c.boundaries").alias("boundaries")
    )


def attach_class_names(pred: DataFrame, classes: DataFrame, label: str = "prediction") -> DataFrame:
    """Names from the class table, ``Class_<i>`` where there is none.

    Classes are few and predictions many, so the names travel to the predictions.
    """
    names = classes.select(F.col("label").alias(label), F.col("name").alias("_name"))
    return join_small(pred, names, label, "left").withColumn(
        "class_name", F.coalesce("_name", F.concat(F.lit("Class_"), F.col(label)))
    ).drop("_name")


def finish_regression(pred: DataFrame, low: Column | float | None, high: Column | float | None, raw: str = "raw") -> DataFrame:
    """Score held inside its range and rounded; without a range the raw value is the score."""
    value = F.col(raw) if low is None else denormalise(F.col(raw), low, high)
    return pred.select("*", F.round(value, 2).alias("value"), F.round(F.col(raw), 4).alias("raw_output"))


def finish_classification(pred: DataFrame, logits: str = "logits") -> DataFrame:
    """Class, confidence in percent, and all probabilities in percent."""
    p = softmax(F.col(logits))
    rows = pred.withColumn("probabilities", p)
    return rows.select(
        "*",
        top_class(F.col("probabilities")).alias("prediction"),
        F.round(F.array_max("probabilities") * 100, 1).alias("confidence"),
    )


def class_details(finished: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """One row per prediction and class: name, probability in percent, printed edges."""
    classes = cut(classes)  # few rows, read for the names and for the edges
    rows = finished.select(key, F.posexplode("probabilities").alias("label", "p")).select(
        key, F.col("label").cast("int").alias("label"), F.round(F.col("p") * 100, 1).alias("probability")
    )
    named = attach_class_names(rows, classes, "label")
    edges = classes.where(F.size("boundaries") > 0).agg(F.min_by("boundaries", "label").alias("b")).scalar()
    text = F.when(
        F.size(edges) > F.col("label") + 1,
        F.format_string("[%d-%d]", F.get(edges, F.col("label")), F.get(edges, F.col("label") + 1)),
    ).otherwise("")
    return named.withColumn("range", F.coalesce(text, F.lit("")))


def catalogue_entry(
    stem: str,
    mode: str,
    feature: str,
    samples: DataFrame,
    metrics: DataFrame,
    history: DataFrame,
    scaler_record: dict,
    config: dict,
) -> DataFrame:
    """One nested record per model.

    Sample ids are not packed into the record: they stay in the samples table under the model's
    stem, since their number has no bound. History has at most 1000 epochs.
    """
    facts = one_row(
        samples.agg(
            count_rows().alias("total_samples"),
            F.count_if(F.col("split") == "train").alias("train_samples"),
            F.count_if(F.col("split") == "val").alias("val_samples"),
            F.min("target").alias("min_target"),
            F.max("target").alias("max_target"),
        )
    )
    by_split = metrics.agg(F.map_from_entries(F.collect_list(F.struct("split", F.struct(*[c for c in metrics.columns if c != "split"])))).alias("m")).scalar()
    curve = history.where(F.col("model") == stem).agg(
        F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_loss"))).alias("h")
    ).scalar()

    def record(values: dict) -> Column:
        return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))

    return samples.sparkSession.range(1).select(
        F.lit(stem).alias("stem"),
        F.lit(feature).alias("target_feature"),
        F.lit(mode).alias("training_mode"),
        record(config).alias("training_config"),
        record(scaler_record).alias("normalization"),
        facts.alias("dataset"),
        by_split.alias("metrics"),
        curve.alias("training_history"),
        F.current_timestamp().alias("trained_at"),
    )


def sample_ids(samples: DataFrame, stem: str) -> DataFrame:
    """Id rows of a model's two sides, stored next to its record."""
    return samples.select(F.lit(stem).alias("stem"), F.col("sample_id").cast("string").alias("sample_id"), "split")
