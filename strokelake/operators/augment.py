"""Seeded augmentation of drawings as segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strokelake.config import AUGMENTATION, CANVAS, Augmentation, Canvas
from strokelake.functions import geometry as G, labels as L
from strokelake.functions.values import uniform_between, uniform_int
from strokelake.operators.profile import count_rows
from strokelake.operators.scaler import Scaler

KEY = "drawing_id"
SAMPLE = [KEY, "aug_idx"]
ENDS = ["x1", "y1", "x2", "y2"]
PARAMS = ["rotation", "tx", "ty", "scale"]


def fan_out(df: DataFrame, n: int = AUGMENTATION.variants, global_share: float = AUGMENTATION.global_share) -> DataFrame:
    """One original (``aug_idx`` null-free 0) and n variants per row; the first share is moved as a whole only."""
    plain = int(n * global_share)
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("aug_idx"))
    kind = F.when(F.col("aug_idx") == 0, "original").when(F.col("aug_idx") <= plain, "global").otherwise("warp+global")
    return rows.withColumn("kind", kind)


def draw_params(df: DataFrame, seed: int, cfg: Augmentation = AUGMENTATION) -> DataFrame:
    """Rotation, shift and scale per sample; the draw depends on the sample only."""
    who = [F.col(KEY), F.col("aug_idx")]
    return df.withColumns(
        {
            "rotation": uniform_between(*cfg.rotation, "rotation", seed, *who),
            "tx": uniform_int(*cfg.shift, "tx", seed, *who),
            "ty": uniform_int(*cfg.shift, "ty", seed, *who),
            "scale": uniform_between(*cfg.scale, "scale", seed, *who),
        }
    )


def _halved(value: Column) -> Column:
    return (value * 0.5).cast("int")


def with_safety(df: DataFrame, out: str, canvas: Canvas = CANVAS, margin: int = AUGMENTATION.safety_margin) -> DataFrame:
    """Whether the margins around the ink box (``x_min .. y_max``) survive the worst case of the row's parameters.

    A drawing without ink cannot be clipped. The shared parts are columns of their own: written as one expression the margin would be spelled out four times, and the generated
    method grows past what the JVM compiles.
    """
    r, tx, ty, s = (F.col(c) for c in PARAMS)
    span = F.greatest(F.col("y_max") - F.col("y_min") + 1, F.col("x_max") - F.col("x_min") + 1)
    turned = F.floor(F.col("_span") * F.sin(F.radians(F.abs(r))) * 0.5)
    grown = F.when(s > 1, F.floor(F.col("_span") * (s - 1.0) * 0.5)).otherwise(0)
    need = F.col("_need")
    fits = (
        (F.col("y_min") >= need + F.greatest(-ty, F.lit(0)))
        & (canvas.height - F.col("y_max") - 1 >= need + F.greatest(ty, F.lit(0)))
        & (F.col("x_min") >= need + F.greatest(-tx, F.lit(0)))
        & (canvas.width - F.col("x_max") - 1 >= need + F.greatest(tx, F.lit(0)))
    )
    rows = df.withColumn("_span", span).withColumn("_need", margin + turned + grown)
    return rows.withColumn(out, F.coalesce(fits, F.lit(True))).drop("_span", "_need")


def soften(df: DataFrame, canvas: Canvas = CANVAS) -> DataFrame:
    """Back off unsafe parameters: half rotation and shift; if that is unsafe too, half again and half the scaling."""
    r, tx, ty, s = (F.col(c) for c in PARAMS)
    safe, again = F.col("_safe"), ~F.col("_safe") & ~F.col("_safe2")
    one = with_safety(df, "_safe", canvas).withColumns(
        {
            "rotation": F.when(safe, r).otherwise(r * 0.5),
            "tx": F.when(safe, tx).otherwise(_halved(tx)),
            "ty": F.when(safe, ty).otherwise(_halved(ty)),
        }
    )
    two = with_safety(one, "_safe2", canvas).withColumns(
        {
            "rotation": F.when(again, r * 0.5).otherwise(r),
            "tx": F.when(again, _halved(tx)).otherwise(tx),
            "ty": F.when(again, _halved(ty)).otherwise(ty),
            "scale": F.when(again, 1.0 + (s - 1.0) * 0.5).otherwise(s),
        }
    )
    return two.withColumn("safety_adjusted", ~safe).drop("_safe", "_safe2")


def apply_affine(seg: DataFrame, canvas: Canvas = CANVAS) -> DataFrame:
    """Move both ends by the row's parameters about the canvas centre."""
    centre = (canvas.width / 2, canvas.height / 2)
    r, tx, ty, s = (F.col(c) for c in PARAMS)
    a = G.affine(F.col("x1"), F.col("y1"), centre, r, s, tx, ty)
    b = G.affine(F.col("x2"), F.col("y2"), centre, r, s, tx, ty)
    return seg.withColumns(dict(zip(ENDS, (*a, *b))))


def control_points(canvas: Canvas = CANVAS) -> list[tuple[float, float]]:
    places = (0.25, 0.5, 0.75)
    return [(canvas.width * h, canvas.height * v) for v in places for h in places]


def displacement_bound(at: float, size: int, cfg: Augmentation = AUGMENTATION) -> int:
    """Largest whole-pixel displacement of a control point along one axis."""
    room = max(0, min(cfg.warp_displacement, at - cfg.safety_margin, size - at - cfg.safety_margin))
    if room < 2:
        room = min(2, cfg.warp_displacement * 0.3)
    return int(room)


def with_displacements(df: DataFrame, seed: int, canvas: Canvas = CANVAS, cfg: Augmentation = AUGMENTATION) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Whole-pixel displacements of the control points, drawn from the sample.

    Six ten-bit draws come out of one hash, so a row hashes three times, not eighteen.
    """
    points = control_points(canvas)
    bounds = [displacement_bound(at, size, cfg) for p in points for at, size in zip(p, (canvas.width, canvas.height))]
    hashes = {f"_h{k}": F.xxhash64(F.lit(f"warp-{k}"), F.lit(seed), KEY, "aug_idx") for k in range((len(bounds) + 5) // 6)}
    draws = []
    for n, bound in enumerate(bounds):
        bits = F.shiftrightunsigned(F.col(f"_h{n // 6}"), 10 * (n % 6)).bitwiseAND(F.lit(1023))
        draws.append(F.pmod(bits, F.lit(2 * bound + 1)) - bound)
    return df.withColumns(hashes), list(zip(draws[::2], draws[1::2]))


def local_warp(
    df: DataFrame,
    points: list[tuple[str, str]],
    moves: list[tuple[Column, Column]],
    canvas: Canvas = CANVAS,
    cfg: Augmentation = AUGMENTATION,
) -> DataFrame:
    """Shift point columns by the inverse-square-distance mean of nine control displacements.

    The shift fades to nothing over the edge band, and the points stay on the canvas. Draws,
    weights and totals are columns of their own steps, so that none is computed twice.
    """
    columns = df.columns
    flat = {f"_m{i}{axis}": c for i, pair in enumerate(moves) for axis, c in zip("xy", pair)}
    df = df.withColumns(flat)
    weights = {}
    for k, (x, y) in enumerate(points):
        for i, (cx, cy) in enumerate(control_points(canvas)):
            dx, dy = F.col(x) - cx, F.col(y) - cy
            weights[f"_w{k}_{i}"] = 1.0 / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    df = df.withColumns(weights)

    def fade(at: Column, size: int) -> Column:
        edge = float(cfg.warp_edge)
        return G.clip(F.least((at - edge) / edge, (size - 1 - at - edge) / edge), 0.0, 1.0)

    def plus(parts: list[Column]) -> Column:
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    out = {}
    for k, point in enumerate(points):
        w = [F.col(f"_w{k}_{i}") for i in range(len(moves))]
        for axis, name, size in zip("xy", point, (canvas.width, canvas.height)):
            shift = plus([wi * F.col(f"_m{i}{axis}") for i, wi in enumerate(w)]) / plus(w)
            at = F.col(name)
            out[name] = G.clip(at + shift * fade(at, size), 0.0, float(size - 1))
    return df.withColumns(out).select(*columns)


def box_edges() -> dict[str, Column]:
    """The aggregates of an ink box."""
    return {
        "x_min": F.min(F.least("x1", "x2")),
        "y_min": F.min(F.least("y1", "y2")),
        "x_max": F.max(F.greatest("x1", "x2")),
        "y_max": F.max(F.greatest("y1", "y2")),
    }


def sample_bounds(seg: DataFrame, keys: list[str]) -> DataFrame:
    return seg.groupBy(*keys).agg(*(edge.alias(name) for name, edge in box_edges().items()))


def augmented_segments(
    seg: DataFrame, seed: int, n: int = AUGMENTATION.variants, canvas: Canvas = CANVAS
) -> tuple[DataFrame, DataFrame]:
    """Segments of all samples, and one parameter row per sample (null parameters for originals).

    The lines are shuffled by drawing and never again. A drawing's samples draw their parameters once, from a row each, and meet the
    lines there, which is the fan-out. Whole-drawing variants share their drawing's box; warped ones take theirs from a
    window over the sample. The number of tasks is not left to the bytes shuffled: the work per byte is many times the usual.
    """
    tasks = int(seg.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = seg.select(KEY, "line_id", *ENDS).repartition(tasks, KEY)
    kinds = ["original", "global"]
    samples = draw_params(fan_out(sample_bounds(lines, [KEY]), n), seed)
    whole = soften(samples.where(F.col("kind").isin(kinds)), canvas)
    drawn = samples.where(~F.col("kind").isin(kinds)).select(*SAMPLE, "kind", *PARAMS)

    hashed, moves = with_displacements(lines.join(drawn, KEY).withColumns({c: F.col(c).cast("double") for c in ENDS}), seed, canvas)
    bent = local_warp(hashed, [("x1", "y1"), ("x2", "y2")], moves, canvas)
    bent = bent.select(*SAMPLE, "kind", "line_id", *ENDS, *PARAMS)
    sample = W.partitionBy(*SAMPLE)
    bent = bent.withColumns({name: edge.over(sample) for name, edge in box_edges().items()})

    ends = dict(zip(ENDS, (canvas.width, canvas.height, canvas.width, canvas.height)))

    def moved(df: DataFrame) -> DataFrame:
        held = {c: G.clip(F.col(c), 0.0, float(size - 1)) for c, size in ends.items()}
        return apply_affine(df, canvas).withColumns(held).select(*SAMPLE, "line_id", "kind", *ENDS)

    still = lines.join(whole, KEY)
    original = still.where(F.col("kind") == "original").select(
        *SAMPLE, "line_id", "kind", *(F.col(c).cast("double").alias(c) for c in ENDS)
    )
    plain = moved(still.where(F.col("kind") == "global"))
    warped = moved(soften(bent, canvas))

    used = [*PARAMS, "safety_adjusted"]
    keep = F.col("kind") != "original"
    bent_boxes = bent.groupBy(*SAMPLE, "kind").agg(*(F.first(c).alias(c) for c in [*PARAMS, *box_edges()]))
    params = whole.select(*SAMPLE, "kind", *(F.when(keep, F.col(c)).alias(c) for c in used)).unionByName(
        soften(bent_boxes, canvas).select(*SAMPLE, "kind", *used)
    )
    return original.unionByName(plain).unionByName(warped), params


def augmented_samples(
    drawings: DataFrame, params: DataFrame, feature: str, scaler: Scaler | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sample records (label scaled and raw, parameters or null) and the rows that have no usable label."""
    value = L.target_value(F.col("features_data"), feature)
    labelled = drawings.withColumn("_target", value)
    errors = labelled.where(F.col("_target").isNull()).select(
        KEY, F.concat(F.lit("Image "), F.col(KEY), F.lit(f" missing feature {feature}")).alias("error")
    )
    scaled = scaler.scale(F.col("_target")) if scaler else F.col("_target")
    suffix = F.when(F.col("aug_idx") == 0, "original").otherwise(F.concat(F.lit("aug"), F.col("aug_idx") - 1))
    used = F.struct(
        F.col("kind").alias("augmentation_type"), "rotation", F.col("tx").alias("translation_x"),
        F.col("ty").alias("translation_y"), "scale", "safety_adjusted",
    )
    columns = [c for c in ("split",) if c in drawings.columns]
    rows = labelled.where(F.col("_target").isNotNull()).join(params, KEY)
    samples = rows.select(
        F.concat_ws("_", "patient_id", F.concat(F.lit("id"), F.col(KEY)), suffix).alias("sample_id"),
        KEY,
        "patient_id",
        "aug_idx",
        *columns,
        F.lit(feature).alias("target_feature"),
        scaled.alias("target_value"),
        F.col("_target").alias("target_value_original"),
        F.when(F.col("aug_idx") > 0, used).alias("augmentation"),
    )
    return samples, errors


def augmentation_stats(samples: DataFrame) -> DataFrame:
    """Originals, variants and total per split, with the multiplier."""
    original = F.count_if(F.col("aug_idx") == 0)
    return samples.groupBy("split").agg(
        original.alias("original"), F.count_if(F.col("aug_idx") > 0).alias("augmented"), count_rows().alias("total")
    ).withColumn("multiplier", F.when(F.col("original") > 0, F.col("total") / F.col("original")))


def infer_augmentation_stats(files: DataFrame) -> DataFrame:
    """The same from file names alone, where no statistics were stored."""
    return files.groupBy("split").agg(
        count_rows().alias("total"),
        F.count_if(F.col("name").contains("original")).alias("original"),
        F.count_if(F.col("name").contains("aug")).alias("augmented"),
    )
