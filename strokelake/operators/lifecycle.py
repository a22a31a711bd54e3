"""Upserts, deletes, hash maintenance, filters, paging, template edits.

Plain Parquet has no in-place update: operators on DataFrames return the new rows, and
``strokelake.sources.sinks.publish_snapshot`` puts them in place of the old ones. Updates of a few
keys go through ``strokelake.sources.keyed_table``, which rewrites only the files that hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.functions import labels as L
from strokelake.functions.values import content_hash
from strokelake.operators.keyed import measured
from strokelake.operators.profile import count_rows
from strokelake.session import cut


def upsert(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], insert: bool = False
) -> DataFrame:
    """Replace ``columns`` where a key matches, other columns stay; ``insert`` adds rows of new keys.

    ``updates`` holds one row per key. A null in an update is a value (it clears), so the match
    flag decides, not the value.
    """
    keys = list(keys)
    new = updates.select(*keys, F.struct(*columns).alias("_u"))
    joined = base.join(new, keys, "full" if insert else "left")
    return joined.select(
        *(
            F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        )
    )


def clear_labels(df: DataFrame, ids: DataFrame, key: str = "drawing_id") -> DataFrame:
    flagged = df.join(ids.select(key, F.lit(True).alias("_c")).distinct(), key, "left")
    bag = F.when(F.col("_c").isNull(), F.col("features_data"))
    return flagged.withColumn("features_data", bag).drop("_c")


def delete_by_key(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def delete_evaluations(
    evals: DataFrame, drawings: DataFrame, features: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove evaluations; a drawing goes with its features once no evaluation refers to it."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    flagged = evals.join(gone, "id", "left")
    orphans = flagged.groupBy("image_id").agg(
        F.count_if(F.col("_gone").isNull()).alias("left"), F.count("_gone").alias("gone")
    ).where((F.col("left") == 0) & (F.col("gone") > 0)).select(F.col("image_id").alias("drawing_id"))
    kept = flagged.where(F.col("_gone").isNull()).drop("_gone")
    return kept, drawings.join(orphans, "drawing_id", "left_anti"), features.join(orphans, "drawing_id", "left_anti")


def delete_stored_evaluations(evals, drawings, features, ids: DataFrame):
    """The same cascade on stored tables (``KeyedTable``): only files with a removed key are written again.

    Orphans are looked for among the drawings that the removed rows name, not among all.
    """
    gone = measured(ids.select("id").distinct())
    rows = evals.read()
    named = measured(rows.join(gone, "id", "left_semi").select("image_id").distinct())
    left = rows.join(named, "image_id", "left_semi").join(gone, "id", "left_anti").select("image_id")
    orphans = cut(named.join(left.distinct(), "image_id", "left_anti").select(F.col("image_id").alias("drawing_id")))
    return evals.delete(gone), drawings.delete(orphans), features.delete(orphans)


def backfill_hash(df: DataFrame, original: str, processed: str) -> DataFrame:
    """Fill only missing hashes; adds the column where it does not exist yet."""
    if "image_hash" not in df.columns:
        df = df.withColumn("image_hash", F.lit(None).cast("string"))
    empty = F.col("image_hash").isNull() | (F.col("image_hash") == "")
    return df.withColumn(
        "image_hash", F.when(empty, content_hash(F.col(original), F.col(processed))).otherwise(F.col("image_hash"))
    )


def hash_stats(df: DataFrame) -> DataFrame:
    """Totals, rows with and without a hash, groups of equal hashes."""
    has = F.col("image_hash").isNotNull() & (F.col("image_hash") != "")
    groups = df.groupBy("image_hash").agg(count_rows().alias("n"))
    return groups.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("with_hash"),
        F.coalesce(F.sum(F.when(~has, F.col("n")).when(F.col("image_hash").isNull(), F.col("n"))), F.lit(0)).alias("without_hash"),
        F.count_if(has & (F.col("n") > 1)).alias("duplicate_groups"),
    )


def duplicate_groups(df: DataFrame) -> DataFrame:
    has = F.col("image_hash").isNotNull() & (F.col("image_hash") != "")
    return df.where(has).groupBy("image_hash").agg(count_rows().alias("n")).where(F.col("n") > 1)


def repair_hashes(df: DataFrame, source: str, original: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Recompute one source's hashes from the original bytes; returns rows and status counts."""
    mine = F.col("source_format") == source
    fresh = F.sha2(F.col(original).cast("binary"), 256)
    status = F.when(F.col(original).isNull(), "error").when(fresh.eqNullSafe(F.col("image_hash")), "unchanged").otherwise("updated")
    rows = df.withColumn("_status", F.when(mine, status))
    counts = rows.where(F.col("_status").isNotNull()).groupBy(F.col("_status").alias("status")).agg(count_rows().alias("n"))
    hashed = F.when(F.col("_status") == "updated", fresh).otherwise(F.col("image_hash"))
    fixed = rows if dry_run else rows.withColumn("image_hash", hashed)
    return fixed.drop("_status"), counts


def filter_drawings(df: DataFrame, **equal) -> DataFrame:
    """Equality filters joined by AND; a filter of None is no filter."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def filter_ground_truth(df: DataFrame, has: bool | None) -> DataFrame:
    if has is None:
        return df
    truth = F.col("ground_truth_correct")
    return df.where(truth.isNotNull() if has else truth.isNull())


def with_feature(df: DataFrame, feature: str) -> DataFrame:
    return df.where(L.is_labelled(F.col("features_data")) & L.has_feature(F.col("features_data"), feature))


def with_target(df: DataFrame, feature: str, out: str = "target") -> DataFrame:
    """Rows with a numeric target; the others are skipped."""
    rows = df.where(L.is_labelled(F.col("features_data")))
    return rows.withColumn(out, L.target_value(F.col("features_data"), feature)).where(F.col(out).isNotNull())


def low_score(df: DataFrame, below: float = 20.0, feature: str = "Total_Score") -> DataFrame:
    return with_target(df, feature, "score").where(F.col("score") < below)


def select_ids(df: DataFrame, ids: DataFrame, key: str = "drawing_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def lookup(df: DataFrame, **key) -> DataFrame:
    """One row by key, none when absent, with a flag for labels where the table has them."""
    (column, value), = key.items()
    found = df.where(F.col(column) == value).limit(1)
    if "features_data" in df.columns:
        found = found.withColumn("has_labels", F.coalesce(L.is_labelled(F.col("features_data")), F.lit(False)))
    return found


def session_rows(df: DataFrame, session: str, key: str = "drawing_id") -> DataFrame:
    return df.where(F.col("session_id") == session).orderBy(key)


def recent(df: DataFrame, at: str, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """One page with the total count on each row."""
    total = df.agg(count_rows().alias("n")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def first_by(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def head_where(df: DataFrame, condition: Column, n: int, *order: str) -> DataFrame:
    return df.where(condition).orderBy(*order).limit(n)


# --- template edits ------------------------------------------------------------------------

TEMPLATE = ["reference_id", "ref_id", "x1", "y1", "x2", "y2"]


def _renumber(ref: DataFrame) -> DataFrame:
    """Ordinals 0..n-1 per template; a template is small by contract."""
    order = W.partitionBy("reference_id").orderBy("ref_id")
    return ref.withColumn("ref_id", (F.row_number().over(order) - 1).cast("int")).select(*TEMPLATE)


def replace_reference(manual: DataFrame) -> DataFrame:
    """A manual set takes the place of every template; degenerate segments are refused."""
    bad = manual.where((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2")))
    if not bad.isEmpty():
        raise ValueError("a template segment needs two different end points")
    return _renumber(manual)


def add_segment(ref: DataFrame, reference_id: int, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Append one segment to one template, numbered after its last."""
    last = ref.where(F.col("reference_id") == reference_id).agg(F.coalesce(F.max("ref_id"), F.lit(-1)).alias("m"))
    row = last.select(
        F.lit(reference_id).cast(ref.schema["reference_id"].dataType).alias("reference_id"),
        (F.col("m") + 1).cast("int").alias("ref_id"),
        *(F.lit(v).cast("int").alias(c) for v, c in zip((x1, y1, x2, y2), TEMPLATE[2:])),
    )
    return ref.select(*TEMPLATE).unionByName(row)


def drop_segment(ref: DataFrame, reference_id: int, ordinal: int) -> DataFrame:
    return _renumber(ref.where(~((F.col("reference_id") == reference_id) & (F.col("ref_id") == ordinal))))


def clear_segments(ref: DataFrame, reference_id: int) -> DataFrame:
    return ref.where(F.col("reference_id") != reference_id).select(*TEMPLATE)
