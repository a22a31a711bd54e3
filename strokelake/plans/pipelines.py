"""Composed jobs: batch evaluation, training-set assembly, oversampling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from strokelake.config import AUGMENTATION, TOLERANCE
from strokelake.functions import labels as L
from strokelake.operators import augment, lifecycle, match, scaler as scaling, segments, split, synth
from strokelake.operators.ingest import dedup_ingest
from strokelake.session import cut
from strokelake.sources import evaluation_log

KEY = "drawing_id"


def match_drawings(seg: DataFrame, ref: DataFrame, optimal: bool = True, threshold: float | None = TOLERANCE.threshold) -> DataFrame:
    """Matched pairs of every drawing with the template.

    Usual drawings are brought together as segments and solved inside the task; their pairs never move. Very large drawings,
    and those with a template of their own, take the pruned path, which bounds what one task receives.
    """
    size = match.template_size(ref)
    assign = match.assign_segments if optimal else match.assign_greedy
    seg = seg.select(*(c for c in (KEY, match.REF_KEY, "line_id", *match.ENDS) if c in seg.columns))
    if match.REF_KEY in seg.columns:
        return assign(match.score_pairs(seg, ref), size, threshold)
    small, large = match.split_by_size(seg)
    usual = match.matched_segments(small, ref, optimal, threshold).where("listed").select(KEY, "line_id", "ref_id", "similarity")
    return usual if large is None else usual.unionByName(assign(match.score_pairs(large, ref), size, threshold))


def matched_drawings(seg: DataFrame, ref: DataFrame, optimal: bool = True, threshold: float | None = TOLERANCE.threshold) -> DataFrame:
    """All segments with the ``ref_id`` of their match (null: none), in one pass over usual drawings of the only template."""
    seg = seg.select(*(c for c in (KEY, match.REF_KEY, "line_id", *match.ENDS) if c in seg.columns))
    columns = [KEY, "line_id", *match.ENDS, "ref_id"]

    def joined(rows: DataFrame) -> DataFrame:
        pairs = match_drawings(rows, ref, optimal, threshold).select(KEY, "line_id", "ref_id")
        return rows.join(pairs, [KEY, "line_id"], "left").select(*columns)

    if match.REF_KEY in seg.columns:
        return joined(seg)
    small, large = match.split_by_size(seg)
    usual = match.matched_segments(small, ref, optimal, threshold).select(*columns)
    return usual if large is None else usual.unionByName(joined(large))


def match_counts(seg: DataFrame, ref: DataFrame, drawings: DataFrame | None = None, optimal: bool = True) -> DataFrame:
    """Match summary per drawing."""
    return match.segment_summary(matched_drawings(seg, ref, optimal), match.template_size(ref), drawings)


def evaluate_drawings(
    seg: DataFrame,
    ref: DataFrame,
    batch: DataFrame | None = None,
    stored: DataFrame | None = None,
    optimal: bool = True,
    suppress: bool = True,
) -> DataFrame:
    """Match summary of all new drawings: known contents skipped, duplicate segments dropped, matched, counted."""
    drawings = None
    if batch is not None:
        drawings = batch if stored is None else dedup_ingest(batch, stored)
        drawings = drawings.select(KEY).distinct()
        seg = seg.join(drawings, KEY, "left_semi")
    # the kept segments are read twice below: computed once, written to the shared folder
    used = cut(segments.suppress_overlaps(seg)) if suppress else seg
    return match_counts(used, ref, drawings, optimal)


def store_evaluations(
    seg: DataFrame, ref: DataFrame, drawings: DataFrame, root: str, run: str, at: str, reference_id: int = 1, suppress: bool = True
) -> DataFrame:
    """Evaluate drawings (``drawing_id``, ``image_hash``) and append the results once; all stored evaluations."""
    spark = seg.sparkSession
    summary = evaluate_drawings(seg, ref, drawings, suppress=suppress).join(drawings.select(KEY, "image_hash"), KEY)
    rows = evaluation_log.evaluation_rows(summary, run, reference_id, at)
    return evaluation_log.append_run(spark, root, rows, run).read()


@dataclass
class TrainingSet:
    """What training needs: samples with labels, their segments, ids per side, scaler, findings."""

    samples: DataFrame
    segments: DataFrame
    ids: DataFrame
    errors: DataFrame
    scaler: scaling.Scaler | None
    synthetic: DataFrame | None


def load_training_set(drawings: DataFrame, feature: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Labelled rows with target and split, without augmentation."""
    rows = lifecycle.with_target(drawings, feature)
    if L.class_count_of(feature):
        return split.split_classification(rows.withColumn("target", F.col("target").cast("int")), "target", fraction, seed, KEY)
    return split.split_by_advice(rows, "target", fraction, seed, KEY)


def low_score_lines(drawings: DataFrame, seg: DataFrame, below: float = 20.0) -> DataFrame:
    low = lifecycle.low_score(drawings, below).select(KEY)
    return seg.join(low.distinct(), KEY, "left_semi")


def synthesise_low_scores(
    drawings: DataFrame, seg: DataFrame, ref: DataFrame, n: int, feature: str, seed: int = 42, below: float = 20.0
) -> tuple[DataFrame, DataFrame]:
    """Labelled synthetic drawings and their segments; their ids are negative to stay apart from stored ones."""
    wanted, pieces = synth.synthesise(low_score_lines(drawings, seg, below), ref, n, seed)
    k = L.class_count_of(feature)
    edges = None
    if k:
        row = (
            drawings.where(L.is_labelled(F.col("features_data")))
            .select(F.try_element_at(L.class_map(F.col("features_data")), F.lit(str(k)))["boundaries"].alias("b"))
            .where(F.col("b").isNotNull())
            .first()
        )
        edges = list(row["b"]) if row else None
    labels = synth.label_synthetic(wanted, feature, k, edges).withColumn(KEY, -F.col("synth_id") - 1)
    # fixed layout of the piece number: origin, slot, step
    origin = F.when(F.col("origin") == "real", 0).when(F.col("origin") == "template", 1).otherwise(2)
    line = (origin * 1_000_000 + F.col("slot") * 1_000 + F.col("step") + 1).cast("int")
    lines = pieces.select((-F.col("synth_id") - 1).alias(KEY), line.alias("line_id"), "x1", "y1", "x2", "y2")
    return labels, lines


def prepare_training_set(
    drawings: DataFrame,
    seg: DataFrame,
    ref: DataFrame,
    feature: str,
    fraction: float = 0.8,
    seed: int = 42,
    synthetic_n: int = 0,
    variants: int = AUGMENTATION.variants,
    normalise: bool = True,
    fit_on: str = "all",
    augment_val: bool = True,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> TrainingSet:
    """Filter, add synthetic samples, split, fit the scaler, augment; everything stays a plan until written."""
    rows = lifecycle.with_feature(drawings, feature).select(KEY, "patient_id", "features_data")
    lines = seg.select(KEY, "line_id", "x1", "y1", "x2", "y2")
    made = None
    if synthetic_n:
        made, extra = synthesise_low_scores(drawings, seg, ref, synthetic_n, feature, seed)
        made, extra = cut(made), cut(extra)
        rows = cut(rows.unionByName(made.select(KEY, "patient_id", "features_data")))
        lines = lines.unionByName(extra)
    if transform:
        rows = rows.transform(transform)
    # labels and sides feed every later step; they hold no image bytes, so one written copy is small
    parted = cut(load_training_set(rows, feature, fraction, seed))
    fitted = None
    if normalise and not L.class_count_of(feature):
        base = parted if fit_on == "all" else parted.where(F.col("split") == "train")
        fitted = scaling.scaler_for_feature(base, "target", feature)
    used = lines.join(parted.select(KEY, "split"), KEY)
    moved, params = augment.augmented_segments(used.drop("split"), seed, variants)
    samples, errors = augment.augmented_samples(parted, params, feature, fitted)
    if not augment_val:
        samples = samples.where((F.col("split") == "train") | (F.col("aug_idx") == 0))
        moved = moved.join(samples.select(KEY, "aug_idx"), [KEY, "aug_idx"], "left_semi")
    ids = parted.select(
        F.when(F.col(KEY) < 0, F.concat(F.lit("synthetic_bad_"), -F.col(KEY) - 1)).otherwise(F.col(KEY).cast("string")).alias("sample_id"),
        "split",
        "target",
    )
    return TrainingSet(samples, moved, ids, errors, fitted, made)
