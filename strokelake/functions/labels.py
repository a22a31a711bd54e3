"""The label bag (JSON text of a drawing) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLASS_KEY = "Custom_Class"
CLASS_SCHEMA = "map<string,struct<label:int,name_custom:string,name_generic:string,boundaries:array<int>>>"


def is_labelled(features: Column) -> Column:
    return features.isNotNull() & ~features.isin("{}", "null")


def label_map(features: Column) -> Column:
    """Keys to raw value text; nested objects keep their JSON text."""
    return F.from_json(features, "map<string,string>")


def class_map(features: Column) -> Column:
    return F.from_json(F.try_element_at(label_map(features), F.lit(CLASS_KEY)), CLASS_SCHEMA)


def class_count_of(feature: str) -> int | None:
    """``Custom_Class_4`` is the 4-class target; any other name is a plain score."""
    head, _, tail = feature.rpartition("_")
    return int(tail) if head == CLASS_KEY and tail.isdigit() else None


def raw_target(features: Column, feature: str) -> Column:
    k = class_count_of(feature)
    if k is None:
        return F.try_element_at(label_map(features), F.lit(feature))
    return F.try_element_at(class_map(features), F.lit(str(k)))["label"].cast("string")


def has_feature(features: Column, feature: str) -> Column:
    k = class_count_of(feature)
    if k is None:
        return F.coalesce(F.map_contains_key(label_map(features), feature), F.lit(False))
    return F.coalesce(F.map_contains_key(class_map(features), str(k)), F.lit(False))


def target_value(features: Column, feature: str) -> Column:
    """The target as a number; null when absent or no number."""
    return raw_target(features, feature).try_cast("double")


def put_label(features: Column, key: str, value_json: Column) -> Column:
    """Set one key to a JSON value, keep every other key as it was."""
    present = F.coalesce(F.json_object_keys(features), F.array().cast("array<string>"))
    bag = label_map(features)
    kept = F.transform(
        F.filter(present, lambda k: k != key),
        lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), _value_json(bag[k])),
    )
    added = F.concat(F.lit(f'"{key}":'), value_json)
    return F.concat(F.lit("{"), F.concat_ws(",", kept, F.array(added)), F.lit("}"))


def _value_json(text: Column) -> Column:
    """Raw text back to JSON: numbers, literals and nested values stay, the rest is quoted."""
    bare = text.try_cast("double").isNotNull() | text.isin("true", "false") | text.rlike(r"^[\[{]")
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").when(bare, text).otherwise(
        quoted.substr(F.lit(2), F.length(quoted) - 2)
    )


def extraction_meta(meta: Column) -> Column:
    return F.struct(
        F.get_json_object(meta, "$.width").try_cast("int").alias("width"),
        F.get_json_object(meta, "$.height").try_cast("int").alias("height"),
        F.get_json_object(meta, "$.line_thickness").try_cast("double").alias("line_thickness"),
    )


def build_extraction_meta(width: Column, height: Column, thickness: Column, auto_crop: Column, padding: Column) -> Column:
    return F.to_json(
        F.struct(
            width.alias("width"),
            height.alias("height"),
            thickness.alias("line_thickness"),
            auto_crop.alias("auto_crop"),
            padding.alias("padding_px"),
        )
    )


def null_if_zero(value: Column) -> Column:
    """Counts of zero (and below) are stored as null."""
    return F.when(value > 0, value)
