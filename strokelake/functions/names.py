"""File names, model names and class texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strokelake.config import PRESET_CLASS_NAMES


def _first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def patient_id(filename: Column) -> Column:
    # fixed values: id patterns, in order of priority
    return F.coalesce(
        F.upper(_first_match(filename, r"(?i)(PC\d+)")),
        _first_match(filename, r"(?i)(Park_\d+)"),
        F.upper(_first_match(filename, r"(?i)(TEAM[KD]\d+)")),
        _first_match(filename, r"(?i)(Pro\d+)"),
        F.lit("UNKNOWN"),
    )


def task_type(filename: Column) -> Column:
    name = F.upper(filename)
    return (
        F.when(name.contains("REFERENCE"), "REFERENCE")
        .when(name.contains("RECALL"), "RECALL")
        .when(name.contains("COPY"), "COPY")
        .otherwise("UNKNOWN")
    )


def strip_extension(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")


def parse_rated_name(filename: Column) -> Column:
    """``{ID}_{COND}.ext`` as a struct; null when the last token is no rated task."""
    parts = F.split(strip_extension(filename), "_")
    task = F.upper(F.element_at(parts, -1))
    known = (F.size(parts) >= 2) & task.isin("COPY", "RECALL")
    return F.when(
        known,
        F.struct(
            F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_").alias("patient_id"),
            task.alias("task_type"),
        ),
    )


def recording_id(filename: Column) -> Column:
    """Last token starting ``PC``, else last starting ``Pro``."""
    parts = F.split(filename, "_")

    def last_with(prefix: str) -> Column:
        return F.try_element_at(F.filter(parts, lambda p: p.startswith(prefix)), F.lit(-1))

    return F.coalesce(last_with("PC"), last_with("Pro"), F.lit("UNKNOWN"))


def parse_model_name(stem: Column) -> Column:
    """``model_{feature}_{date}_{time}`` as a struct of feature and timestamp."""
    parts = F.split(stem, "_")
    n = F.size(parts)
    feature = F.when(n > 3, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 3, F.lit(1))), "_")).when(
        n == 3, F.try_element_at(parts, F.lit(2))
    )
    stamp = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(-2), F.lit(2)), "_"))
    return F.struct(
        F.coalesce(feature, F.lit("unknown")).alias("feature"),
        F.coalesce(stamp, F.lit("unknown")).alias("timestamp"),
    )


def class_name(class_id: Column, low: Column, high: Column) -> Column:
    return F.format_string("Class_%d [%d-%d]", class_id, low, high)


def range_text(low: Column, high: Column) -> Column:
    return F.when(low == high, F.format_string("= %d", low)).otherwise(F.format_string("[%d, %d]", low, high))


def range_from_name(generic: Column, class_id: Column) -> Column:
    """The bracketed part of a generic class name, else ``Class <id>``."""
    found = F.nullif(F.regexp_extract(generic, r"(\[[^\]]+\])", 1), F.lit(""))
    return F.coalesce(found, F.concat(F.lit("Class "), class_id))


def preset_names(k: Column, descending: bool = False) -> Column:
    """Names for 2-5 classes, null for any other count."""
    picked = None
    for count, names in PRESET_CLASS_NAMES.items():
        values = F.array(*(F.lit(n) for n in (reversed(names) if descending else names)))
        picked = F.when(k == count, values) if picked is None else picked.when(k == count, values)
    return picked


def preset_name(k: Column, class_id: Column, descending: bool = False) -> Column:
    return F.try_element_at(preset_names(k, descending), (class_id + 1).cast("int"))


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def session_id(prefix: str, at: Column | None = None) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss"))


def hash_prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 16)
